import random

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import ngram_join as J

SF = "/root/testdata/sf0.001/documents.parquet"


def plain_set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF).select("doc_id", "text").collect()]
    assert got(J.jaccard_components(spark.read.parquet(SF))) == brute(rows)


def test_thresholds_chains_and_copies(spark):
    rng = random.Random(5)
    rows, n = [(0, None), (1, ""), (2, " \t "), (3, "one two"), (4, "ONE two"), (5, "é É"), (6, "é é")], 7
    for size in (8, 20, 44, 103, 404):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for edits in (0, 0, 1, 2, size // 30, size // 25, size // 12):
            x = list(words)
            for _ in range(edits):
                x[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(x)))
            n += 1
        for cut in range(1, 5):  # a chain: each is near the one before
            rows.append((n, " ".join(words[cut * size // 10 :] + [f"c{i}" for i in range(cut * size // 10)])))
            n += 1
    passage = " ".join(f"p{i}" for i in range(60))  # shared by many documents that are otherwise different
    for _ in range(60):
        rows.append((n, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60)))))
        n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("component", F.lit(1))
    assert got(J.jaccard_components(df)) == brute(rows)


def test_empty_table_null_ids_and_large_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(J.jaccard_components(empty)) == []
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words, f"t{i}"])) for i in range(1, 700)] + [(None, "a b c d e f")]
    out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out if r.doc_id is not None} == {1} and sum(r.doc_id is None for r in out) == 1


def brute_rows(rows):
    """As brute(), where ids may be null or repeat: each row is a node, null ids take no part."""
    named = [(n, t if i is not None else None) for n, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]
    ids = [i for i, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    sizes = [len(plain_set(t)) for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    return sorted(((ids[n], sizes[n], ids[c]) for n, _, c in brute(named)), key=str)


def near_copies(rng, n):
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    return [" ".join([*words, f"t{k}"]) for k in range(n)]


def rows_of(spark, rows):
    return sorted((tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def test_null_ids_near_other_documents(spark):
    rng, rows = random.Random(8), []
    for k in range(12):
        a, b, c = near_copies(rng, 3)
        rows += [(3 * k, a), (3 * k + 1, b), (None, c)]
    assert rows_of(spark, rows) == brute_rows(rows)


def test_an_id_with_several_texts(spark):
    rng, rows = random.Random(9), []
    for k in range(30):  # each text has one near copy only, so no other way round connects it
        texts = [near_copies(rng, 2) for _ in range(3)]
        rows += [(1000 + k, t) for t, _ in texts] + [(10 * k + j, t) for j, (_, t) in enumerate(texts)]
    rows += rows[:2]
    assert rows_of(spark, rows) == brute_rows(rows)


def test_blocks_compare_all_components(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 2)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(base[: 50 - 5 * (i % 3)] + [f"z{x}" for x in rng.integers(0, 10**6, 3 * (i % 4))])) for i in range(40)]
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, None), (4, "x y z")]
    out = J.dedup_near(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")))
    assert out.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in out.collect()) == [3, 4, 9]


def test_slices_of_parts_and_chunks_of_partners_lose_nothing(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words, f"t{i}"])) for i in range(60)] + [(100 + i, t) for k in range(20) for i, t in enumerate(near_copies(rng, 3), 10 * k)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "PARTNERS", 5)
    assert got(J.jaccard_components(df)) == want
    flat, size = J.shingle_sets([t for _, t in rows])
    sig, at, _ = J.signatures(flat, size)
    node = np.array([J.node_of(flat[e - n : e]) for n, e in zip(size, np.cumsum(size), strict=True)])
    batches = list(J._emit(3)(iter([J.pa.RecordBatch.from_arrays([J.pa.array([i for i, _ in rows]), J.pa.array([t for _, t in rows]), J.pa.array(range(len(rows)))], ["id", "text", "hash"])])))
    pairs = lambda: {(a, b) for x in J._bucket(iter(batches)) for k, a, b in zip(*(x.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True) if k == 2}
    whole = pairs()
    monkeypatch.setattr(J, "SORTED", 100)
    assert pairs() == whole and len(whole) > 60 and {a for p in whole for a in p} <= set(node.tolist()) and len(sig) == len(at)
