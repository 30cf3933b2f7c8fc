import heapq
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillmark.llm import packing, queries, sharding

SF = "/root/testdata/sf0.001"


def check_packed(out, want, capacity):
    """want: {(doc_id, piece): (start, length, crc)}; returns the number of sequences."""
    rows = out.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(by)


def wanted(rows, capacity):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, x in enumerate(range(0, len(ids), capacity)):
            out[i, k] = (x, len(ids[x : x + capacity]), zlib.crc32(ids[x : x + capacity].tobytes()))
    return out


@pytest.mark.parametrize("deme", [4096, 40])
def test_whole_table(spark, monkeypatch, deme):
    monkeypatch.setattr(packing, "DEME", deme)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = wanted(rows, 2048)
    n = check_packed(queries.op5_best_fit_packing(spark, SF), want, 2048)
    least = -(-sum(length for _, length, _ in want.values()) // 2048)
    assert least <= n <= least + 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a " * 9), (4, "b " * 10), (5, "c " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("island", F.lit(1))
    check_packed(packing.pack_documents(df, P.path("word_bpe_49k.json"), 0, 10), wanted(rows, 10), 10)
    assert packing.pack_documents(df.limit(0), P.path("word_bpe_49k.json"), 0, 10).count() == 0
    twice = spark.createDataFrame([(None, "x"), (7, "x y"), (7, "x y")], "doc_id long, text string")
    assert packing.pack_documents(twice, P.path("word_bpe_49k.json"), 0, 10).count() == 3


@pytest.mark.parametrize("lengths", [[1500] * 5000, [700] * 9001, [1500] * 5000 + [500] * 300])
def test_pieces_that_do_not_combine_end(spark, monkeypatch, lengths):
    real, staged = packing.common.stage, []

    def stage(df, name):
        staged.append(name)
        assert len(staged) < 20, "no progress"
        return real(df, name)

    monkeypatch.setattr(packing.common, "stage", stage)
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = check_packed(packing.pack(df, 2048), {(i, 0): (0, n, i) for i, n in enumerate(lengths)}, 2048)
    assert n == (4501 if lengths[0] == 700 else 5000)


def test_best_fit_and_crossover_keep_every_item():
    rng = random.Random(3)
    for seed in range(20):
        lengths = [rng.randrange(1, 100) for _ in range(300)]
        bins, room = packing.evolve(lengths, 100, [], 40, np.random.default_rng(seed))
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert [100 - sum(lengths[i] for i in b) for b in bins] == room and min(room) >= 0
        a, b = (packing.evolve(lengths, 100, [], 0, np.random.default_rng(seed + x)) for x in (1, 2))
        child = packing.crossover(lengths, a, b, 100, np.random.default_rng(seed))
        assert sorted(i for x in child[0] for i in x) == list(range(300))
        assert [100 - sum(lengths[i] for i in x) for x in child[0]] == child[1] and min(child[1]) >= 0


def test_evolution_beats_best_fit_decreasing(spark):
    lengths = [70, 30, 60, 40, 50, 50, 45, 35, 20] * 30  # 120 full bins exist
    bins, room = [], []
    packing.best_fit(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), 100, bins, room)
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = check_packed(packing.pack(df, 100), {(i, 0): (0, n, i) for i, n in enumerate(lengths)}, 100)
    assert 120 <= n < len(bins)


def test_crossover_and_migration_decide_the_packing_of_real_documents(spark):
    rows = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), P.path("word_bpe_49k.json"), 0, 2048)
    lengths = sorted((r.length for r in rows.collect()), reverse=True)
    bound = -(-sum(lengths) // 2048)
    start = [packing.evolve(lengths, 2048, [], 0, np.random.default_rng(k)) for k in range(packing.ISLANDS)]
    alone = [packing.evolve(lengths, 2048, [], packing.GENERATIONS[0], np.random.default_rng(k)) for k in range(packing.ISLANDS)]
    met = packing.evolve(lengths, 2048, alone, packing.GENERATIONS[1], np.random.default_rng(9))
    fit = lambda p: packing.fitness(p[1], 2048)
    assert all(len(s[0]) > bound for s in start) and all(fit(a) > fit(s) for s, a in zip(start, alone, strict=True))
    assert fit(met) >= max(map(fit, alone)) and len(met[0]) <= bound + 1 < min(len(s[0]) for s in start)
    out = packing.pack(rows, 2048)
    assert out.select("sequence_id").distinct().count() <= bound + 1


def check_shards(rows, out, shards):
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    slots, loads = {}, [0] * shards
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = dict(rows)
    where = {}
    for r in got:
        if r.doc_id is not None:
            assert where.setdefault(text[r.doc_id] or "", r.shard) == r.shard
    return loads


def lpt(sizes, shards):
    heap = [0] * shards
    for s in sorted(sizes, reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + s)
    return sorted(heap)


def test_shards_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t.encode()) + 8
    loads = check_shards(rows, queries.op3_sharding(spark, SF), 24)
    assert sorted(loads) == lpt(groups.values(), 24)


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, None)] + [(i, "hot") for i in range(4, 60)] + [(i, "x" * rng.randrange(1000)) for i in range(60, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("entry", F.lit("x"))
    loads = check_shards(rows, sharding.shard(df, 5), 5)
    groups = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 8
    assert sorted(loads) == lpt(groups.values(), 5)
    monkeypatch.setattr(sharding, "BULK", 0)
    assert sorted(check_shards(rows, sharding.shard(df, 5), 5)) == lpt(groups.values(), 5)
    assert sharding.shard(df.limit(0), 5).count() == 0
    assert sharding.shard(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), 24).count() == 2


def test_schedule_is_that_of_the_heap_for_any_sizes(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        sizes = {rng.randrange(1, 60): rng.choice([1, 2, rng.randrange(1, 200)]) for _ in range(rng.randrange(9))}
        want = lpt([s for s, n in sizes.items() for _ in range(n)], 7)
        for least in (0, 1, 16):
            monkeypatch.setattr(sharding, "BULK", least)
            plan, loads = sharding.schedule(list(sizes.items()), 7), [0] * 7
            taken = {}
            for size, low, high, shard in plan:
                assert low == taken.get(size, 0) < high
                taken[size] = high
                loads[shard] += size * (high - low)
            assert taken == sizes and sorted(loads) == want
