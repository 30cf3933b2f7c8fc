import hashlib
import random
import zlib

import numpy as np
import pytest

from quillmark.llm import periodic_runs as pr
from quillmark.llm import queries

ROWS = "doc_id long, text string, runs string, collapsed int"


def brute(words, least=24, times=3):
    """Every period, every stretch of matches at that distance."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(doc_id, text):
    words = plant(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    said = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(2500):
        n, k = rng.randrange(150), rng.choice([1, 2, 2, 3, 5, 40])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n:
                a, p = rng.randrange(n), rng.randrange(1, 13)
                for i in range(a, rng.randrange(a, n) + 1):
                    w[i] = w[a + (i - a) % p]
        least, times = rng.choice([24, 24, 12, 9, 30, 3]), rng.choice([3, 3, 4, 5])
        assert pr.find_runs(w, least, times) == brute(w, least, times), (w, least, times)


def test_z_function():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(30))]
        n = len(s)
        want = [next((k for k in range(n - i) if s[k] != s[i + k]), n - i) for i in range(n)]
        assert pr.z_function(np.array(s), n).tolist() == want


def test_long_sequences_are_linear_in_what_repeats():
    assert pr.find_runs([7] * 300_000) == [(0, 300_000, 1)]
    assert pr.find_runs(list(range(500)) * 200) == [(0, 100_000, 500)]
    assert pr.find_runs(list(range(200_000))) == []


def test_a_run_inside_the_period_of_another():
    w = (["x"] * 30 + ["a", "b", "c"]) * 4
    assert pr.find_runs(w) == brute(w) and (0, 132, 33) in pr.find_runs(w) and (33, 30, 1) in pr.find_runs(w)


def test_query_equals_brute_force_on_edge_rows(spark, tmp_path):
    rng = random.Random(5)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    texts = [
        None, "", " \t\n", "a", "la " * 23, "la " * 24, "la " * 25 + "x", "x y z " * 9, "x y z " * 8 + "x y", "a  b\tc\x0b\x0c\rd\n" * 40, "nb\xa0sp " * 30, "日本 語 " * 50,
        " ".join(rng.choice("abc") for _ in range(400)), "q " * 5000 + "r s " * 4000, "x" * 200_000,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 30, 300])))) for i in ids]
    rows += [(None, "la " * 30), (5, "la " * 24), (5, "la " * 24), (-7, "la " * 24)]
    # clashing names of other columns are no matter
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.queries()["op13_periodic_runs"](spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == ["doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint", "runs_sha256 string", "collapsed_sha256 string"]
    got = sorted(((r.doc_id, *tuple(r)[1:]) for r in out.collect()), key=repr)
    want = [(i, *(digests(i, t) if i is not None else (1, 0, 30, 1, 30_000, hashlib.sha256(b"0,30,1\n").hexdigest(), hashlib.sha256(b"la").hexdigest()))) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert queries.queries()["op13_periodic_runs"](spark, str(tmp_path)).where("doc_id < 0").count() == 1


def test_real_outputs_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b " * 20 + "c")], "doc_id long, text string")
    row = pr.periodic_runs(docs).collect()[0]
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (41, [(0, 40, 2)], "a b c")
    assert pr.run_digests(pr.periodic_runs(pr.planted(docs.limit(0)))).collect() == []
    with pytest.raises(ValueError, match="three periods"):
        pr.periodic_runs(docs, times=2)
