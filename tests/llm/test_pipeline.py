import corpus_pipeline as C
import public_tokenizers
from quillmark.llm import common, toxicity

from tests.llm.test_ngram_join import brute
from tests.llm.test_packing_sharding import check_packed, wanted
from tests.llm.test_quality import plain

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    hosts = {}
    for r in rows.values():
        n, f = hosts.get(r.source, (0, 0))
        hosts[r.source] = (n + 1, f + plain(r.text)[-1])
    n, f = len(rows), sum(f for _, f in hosts.values())
    spread = sum(f * f / n for n, f in hosts.values()) / n - (f / n) ** 2
    weight = min(max(f / n * (1 - f / n) / spread - 1, 1), 1e6) if spread > 0 else 1e6
    bad = {s for s, (k, g) in hosts.items() if (g + f / n * weight) / (k + weight) > 0.5}
    one = common.stage(C.quality_rules(spark, docs, SF), "test")
    want = {i for i, r in rows.items() if not plain(r.text)[-1] and r.source not in bad}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    two = common.stage(C.without_toxic(spark, one, SF), "test")
    scores = {r.doc_id: r.predicted for r in toxicity.rate(one, labels, vocabulary=public_tokenizers.path("word_bpe_49k.json")).collect()}
    want = {i for i in want if not scores[i]}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == want
    three = common.stage(C.one_of_each_group(spark, two, SF), "test")
    want = {i for i, _, c in brute([(i, rows[i].text) for i in sorted(want)]) if i == c}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == want
    pieces = wanted([(i, rows[i].text) for i in want], 2048)
    n = check_packed(C.packed(spark, three, SF), pieces, 2048)
    assert n <= -(-sum(p[1] for p in pieces.values()) // 2048) + 2


def test_run_keeps_what_its_stages_keep(spark):
    got = {(r.doc_id, r.piece) for r in C.run(spark, SF).collect()}
    docs = common.table(spark, SF, "documents")
    for _, stage in C.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, SF), "test")
    assert {i for i, _ in got} == {r.doc_id for r in docs.select("doc_id").collect()} and len(got) > 50


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = common.stage(stage(spark, docs, SF), "test")
        assert docs.count() == 0


def test_stages_take_null_ids_repeated_rows_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(40).collect()
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [tuple(r) for r in some] + [tuple(some[0]), tuple(some[1]), tuple(some[1])] + [(None, some[2].text, None, None, None), (None, some[2].text, None, None, None), (None, None, None, "x.org", 0), (90_001, None, "en", None, 0), (90_002, "", "en", "x.org", 0), (90_003, long, "en", some[5].source, 1)]
    odd = spark.createDataFrame(rows, docs.schema).withColumnsRenamed({"n_chars": "score", "lang": "c0"}).selectExpr("*", "1 as node", "'t' as toxic")
    kept = odd
    for name, stage in C.STAGES[:-1]:
        kept = common.stage(stage(spark, kept, SF), "test")
        assert kept.columns == odd.columns, name
    left = kept.collect()
    assert {r.doc_id for r in left if r.doc_id is not None} <= {r[0] for r in rows} and any(r.doc_id == 90_003 for r in left) and all(r.text for r in left)
    packed = C.packed(spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left}
