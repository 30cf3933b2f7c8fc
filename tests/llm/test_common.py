import random

from quillmark.llm import common


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return sorted((x, find(x)) for x in up)


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 112)]
    rng.shuffle(chain)
    star = [(500, i) for i in range(501, 560)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    edges = [(a, b) for a, b in chain + star + loose if a != b] + [(7, -3), (-3, 7)]
    got = common.components(spark.createDataFrame(edges + [(9, 9)], "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == plain(edges)
    assert common.components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_a_worker_keeps_the_caches_of_one_operator(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    gone = []
    common.only("a", lambda: gone.append("a"))
    common.only("a", lambda: gone.append("a"))
    assert gone == []
    common.only("b", lambda: gone.append("b"))
    common.only("c")
    common.only("c")
    assert gone == ["a", "b"]
