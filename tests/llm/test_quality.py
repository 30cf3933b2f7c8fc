import random
import re

import duckdb
from pyspark.sql import functions as F

from quillmark.llm import quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    cover = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    bad = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), bad)


def got(df):
    return sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()))


def odd():
    rng = random.Random(1)
    rows = [None, "", " \n \t", "a", "é " * 40, "x y z w " * 9, "a b c d e f g h " * 5, "## $5 % <b> | & *" * 4, "one\n\none\n one\none \ntwo\n \n", "😀 " * 25]
    for _ in range(60):
        rows.append("".join(rng.choice(["a ", "b ", "c\n", "dd\t", "e  "]) for _ in range(rng.randrange(120))))
    return rows


def test_features_of_odd_rows(spark):
    rows = odd()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).withColumn("n_words", F.lit("clash"))
    out = quality.rate_documents(df)
    assert got(out) == sorted(map(plain, rows)) and out.count() == len(rows)
    assert quality.rate_documents(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_whole_table_and_sql(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op8_host_quality_rules(spark, SF)
    assert got(out) == sorted(map(plain, texts))
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op8_host_quality_rules"])
    names = want.columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in out.select(*names).collect())


def test_sql_of_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(odd())], "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "d"))
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/d/*.parquet'")
    want = duckdb.sql(quality.SQL)
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in quality.rate_documents(df).select(*want.columns).collect())


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [("evil", bad)] * 90 + [("evil", good)] * 10 + [(f"h{k}", good) for k in range(20) for _ in range(50)] + [(None, good), ("one", bad)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = {r.doc_id: r.kept for r in quality.rate_documents(df).collect()}
    assert not any(out[i] for i in range(100)) and all(out[i] for i in range(100, 1101)) and not out[1101]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in out.items() if k)


def test_keys_of_a_host_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "KEY_ROWS", 10)
    rows = spark.createDataFrame([(i, "hot" if i < 500 else None if i < 700 else f"s{i}") for i in range(900)], "id long, src string").repartition(4)
    hosts = rows.groupBy(F.col("src").alias("host")).agg(F.count("*").alias("rows")).withColumn("host_rejected", F.lit(True)).withColumn("rate", F.lit(0.5))
    dealt, spread = quality._dealt(rows, hosts, "src")
    each = {(r.src, r["__key"]): r.n for r in dealt.groupBy("src", "__key").agg(F.count("*").alias("n")).collect()}
    assert max(each.values()) <= 14 and sum(each.values()) == 900 and each.keys() == {(r.host, r["__part"]) for r in spread.collect()}
    out = quality._with_verdict(rows, hosts, "src")
    assert sorted(r.id for r in out.collect()) == list(range(900)) and out.columns == ["id", "src", "host_rate", "host_rejected"]


def test_prior_has_the_moments_asked_for():
    a, b = quality.prior(0.2, 0.01)
    assert abs(a / (a + b) - 0.2) < 1e-12 and abs(a * b / ((a + b) ** 2 * (a + b + 1)) - 0.01) < 1e-12


def test_keep_good_with_clashing_columns_and_odd_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate([*odd(), *odd()])], "doc_id long, text string, source string")
    df = df.select("doc_id", F.lit(1).alias("__w"), "text", F.lit("x").alias("__salt"), "source", F.lit(None).cast("int").alias("base_failed"), F.lit(2).alias("host"), F.lit(3).alias("c0"), F.lit(4).alias("n_words"))
    want = sorted(r.doc_id for r in quality.rate_documents(df).collect() if r.kept)
    for sent, rows in ((quality.MOST_SENT, quality.KEY_ROWS), (-1, quality.KEY_ROWS), (-1, 3)):
        monkeypatch.setattr(quality, "MOST_SENT", sent)
        monkeypatch.setattr(quality, "KEY_ROWS", rows)
        kept = quality.keep_good(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want
        assert {tuple(r)[1::2] for r in kept.collect()} == {(1, "x", None, 3)}
    assert 0 < len(want) < df.count()


def test_verdicts_do_not_multiply_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    rows = quality.features(df).select("doc_id", "text", "source", "base_failed")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") <= 3 and plan.count("sort_array(") <= 2
    assert "xxhash64" not in quality.keep_good(df)._jdf.queryExecution().optimizedPlan().toString()
