import pytest

from quillmark.plans import queries as Q
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, Q.queries()[name], Q.oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_word_error_rate_reads_whole_texts(spark, tmp_path):
    texts = ["a b c", "", "e", "a b " * 120 + "the end here", "few words " * 30 + "é see the bee " * 20, "né ne 見る e é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        r, g = t.split(), t.replace("e", "").split()
        row = list(range(len(g) + 1))
        for n, x in enumerate(r, 1):
            old, row[0] = row[:], n
            for k, y in enumerate(g, 1):
                row[k] = min(old[k] + 1, row[k - 1] + 1, old[k - 1] + (x != y))
        want[i] = row[-1] / len(r) if r else 0.0
    got = {r.doc_id: r.wer for r in Q.queries()["word_error_rate"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 125 and set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
