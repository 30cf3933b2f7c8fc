import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import queries, range_join

SF = "/root/testdata/sf0.1"


def brute(rows, limit=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, up = {k: 0 for k in range(len(ok))}, list(range(len(ok)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (_, x) in enumerate(ok):
        for b, (_, y) in enumerate(ok[:a]):
            if len(x) == len(y) and float(x @ y) / math.sqrt(x @ x) / math.sqrt(y @ y) >= limit:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                up[q] = p
    least = {}
    for k, (i, _) in enumerate(ok):
        least[find(k)] = min(i, least.get(find(k), i))
    out = [(i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(ok)]
    bad = [i for i, v in rows if not (v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v))]
    return sorted(out + [(i, 0, i, True) for i in bad])


def got(df):
    return sorted(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


@pytest.mark.parametrize(("per_pivot", "block"), [(8192, 4096), (20, 7)])
def test_whole_table(spark, monkeypatch, per_pivot, block):
    monkeypatch.setattr(range_join, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(range_join, "BLOCK", block)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = brute(rows)
    assert got(queries.op10_embedding_near_dedup(spark, SF)) == out


ODD = [None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [None, 1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [1.0, 1.0, 1.0], [1e-9, 1e-9, 1e-9], [-0.0, 0.0, 1.0], [0.0, -0.0, 2.0]]


def test_odd_vectors_and_clashing_names(spark):
    rows = list(enumerate(ODD))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("x")).withColumn("v", F.lit(1))
    assert got(df_out(df)) == brute(rows)
    huge = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert [r[:3] for r in got(df_out(huge))] == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def df_out(df):
    return range_join.cosine_components(df)


def test_random_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(range_join, "PER_PIVOT", 25)
    monkeypatch.setattr(range_join, "BLOCK", 11)
    rng = np.random.default_rng(5)
    rows, n = [(900, None), (901, [0.0] * 4), (902, [1.0, 2.0, 3.0])], 0
    for _ in range(15):
        c = rng.normal(size=4)
        for _ in range(16):
            rows.append((n, (c + rng.normal(size=4) * 0.13).tolist()))
            n += 1
    rows += [(500 + k, [3.0, -1.0, 2.0, 0.5]) for k in range(40)] + [(600, [6.0, -2.0, 4.0, 1.0])]
    assert got(df_out(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows)


def test_rings_and_pivots():
    rng = np.random.default_rng(3)
    blocks = range_join.rings([(0, 5, 3000), (0, 6, 3000), (0, 9, 10), (1, 2, 20_000), (1, 3, 1)])
    assert [b[:2] for b in blocks] == [(0, 0), (0, 1), *((1, i) for i in range(5)), (1, 5)][: len(blocks)]
    assert np.allclose([b[2:] for b in blocks[:2]], [(0.005, 0.007), (0.009, 0.01)]) and len({b[2:] for b in blocks[2:7]}) == 1
    spread = range_join._unit(rng.normal(size=(2000, 64)))
    near = range_join._unit(np.repeat(range_join._unit(rng.normal(size=(60, 64))), 40, axis=0) + rng.normal(size=(2400, 64)) * 0.01)
    r = math.sqrt(0.1)
    assert len(range_join.choose_pivots(spread, 125, r)) == 16 and len(range_join.choose_pivots(near, 125, r)) > 16
    assert range_join.met_pairs(spread, range_join.choose_pivots(spread, 125, r), r) > 0.9
    assert range_join.met_pairs(near, range_join.choose_pivots(near, 125, r), r) < 0.2


def test_empty_null_and_repeated_ids(spark):
    assert got(df_out(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.01]), (9, [0.0, 1.0])]
    out = df_out(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in out) == [(-1, 2, -1), (4, 2, 4), (4, 2, 4), (9, 0, 9)]


def test_blocks_grow_with_the_root_of_a_cell():
    def copies(n):
        blocks = range_join.rings([(0, k, n // 100) for k in range(100)])
        return len(blocks)

    few, many, most = copies(50 * range_join.BLOCK), copies(1024 * range_join.BLOCK), copies(4096 * range_join.BLOCK)
    assert 40 <= few <= 60 and 200 <= many <= 320 and 400 <= most <= 640  # 1,024 and 4,096 without growth
    small = range_join.rings([(1, 3, 10), (1, 9, range_join.BLOCK * 3), (2, 0, 1)])
    assert [(c, b) for c, b, _, _ in small] == [(1, 0), (1, 1), (1, 2), (2, 0)] and all(low < high for _, _, low, high in small)


def test_one_very_large_component(spark):
    rng = np.random.default_rng(9)
    base = np.ones(16)
    rows = [(i, (base + rng.normal(0, 0.02, 16)).tolist()) for i in range(3000)] + [(5000 + i, rng.normal(size=16).tolist()) for i in range(20)]
    out = {r.vec_id: r for r in range_join.cosine_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(out[i].component_id == 0 and out[i].n_links == 2999 for i in range(3000)) and sum(r.kept for r in out.values()) == 1 + sum(out[5000 + i].kept for i in range(20))
