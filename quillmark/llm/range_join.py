"""Exact cosine range join of vectors: pivots, triangle inequality, cells that are joined independently.

Unit vectors have a cosine of at least c exactly if they are at most r = sqrt(2 - 2c) apart. Pivots (a bounded
sample) cut the space into cells by the nearest pivot. If y lies in the cell of pivot q and x in that of p, and both
are at most r apart, then d(x, q) <= d(y, q) + r <= d(y, p) + r <= d(x, p) + 2r: so x is copied to each cell q after
its own, in pivot order, with d(x, q) <= d(x, p) + 2r, and each pair is met in one cell. A cell's own vectors are
dealt in blocks of about BLOCK by their distance to the pivot, one task each (by their hash where very many have one
distance); x meets only blocks that hold distances within r of d(x, q), as |d(x, q) - d(y, q)| <= d(x, y). What is
compared with a block streams past it. The number of pivots grows with the rows where more of them, as measured on
the sample, leave out more pairs; where vectors lie about as far from each pivot, no number of them does.

Equal vectors are joined as one, with a weight. A block's task makes no rows for pairs: it counts links by weight,
and gives at most one edge for each vector that has a link (to the root, in the task, of what it links with), so its
output is as large as its input whatever the number of links. Components are made of these edges.

A product in single precision, whose error is bounded, leaves out what is far from the limit; the other cosines are
computed in double precision, and those within EDGE of the limit again from the vectors as they came. Vectors that
are null, empty, zero or have null or non-finite components link with nothing, nor do vectors of different lengths.
Repeated and null ids are rows like any other (a null id counts as a link, but can't name a component).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common

#: Vectors for each pivot at least, fewest and most pivots; vectors of a block; distance to the limit at which cosines
#: are checked.
PER_PIVOT, LEAST_PIVOTS, PIVOTS, BLOCK, EDGE = 8192, 16, 1024, 4096, 1e-9
#: Blocks of a cell from which on they grow, and rows of the largest.
MANY, MOST_BLOCK = 64, 32_768
#: Sampled vectors for each pivot; share of the pairs by which more pivots have to leave out more.
SAMPLE, GAIN = 16, 0.02
#: Slack for rounding in distances to pivots; width of the classes that distances are counted by.
SLACK, STEP = 1e-9, 0.001


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a)) / math.sqrt(math.fsum(b * b))


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart members of a sample: each next one is the farthest from those chosen."""
    chosen, near = [0], 2 - 2 * (sample @ sample[0])
    while len(chosen) < min(count, len(sample)):
        k = int(np.argmax(near))
        if near[k] <= 1e-12:
            break
        chosen.append(k)
        near = np.minimum(near, 2 - 2 * (sample @ sample[k]))
    return sample[chosen]


def met_pairs(sample: np.ndarray, pivots: np.ndarray, radius: float) -> float:
    """Share of all pairs of the sample's distribution that meet in a cell of these pivots, blocks left aside."""
    d, own, reach = _reach(sample, pivots, radius)
    home = np.bincount(own, minlength=len(pivots)) / len(sample)
    return float((home * (reach.sum(0) / len(sample) - home / 2)).sum() * 2)


def choose_pivots(sample: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Few pivots, or more as long as four times as many leave out at least GAIN of all pairs more. They come from one
    half of the sample, the other half tells what they leave out."""
    from_, to = sample[::2], sample[1::2] if len(sample) > 1 else sample
    pivots = pivots_of(from_, min(most, LEAST_PIVOTS))
    met = met_pairs(to, pivots, radius)
    while len(pivots) < most:
        more = pivots_of(from_, min(most, 4 * len(pivots)))
        if len(more) == len(pivots) or (now := met_pairs(to, more, radius)) > met - GAIN:
            break
        pivots, met = more, now
    return pivots


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _reach(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances to the pivots, own cell, which cells a unit vector goes to)."""
    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))
    own, rows = d.argmin(1), np.arange(len(d))
    reach = d <= d[rows, own][:, None] + 2 * radius + SLACK
    reach &= np.arange(len(pivots)) > own[:, None]
    reach[rows, own] = True
    return d, own, reach


def _assign(pivots: np.ndarray, radius: float):
    """(node, weight, v) -> (cell, home, d, node, weight, v): its own cell, and the later ones within reach; d is the
    distance to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                rows = batch.slice(lo, 2000)
                x = np.frombuffer(b"".join(rows.column("v").to_pylist()), "<f8").reshape(rows.num_rows, -1)
                d, own, reach = _reach(_unit(x), pivots, radius)
                i, cell = np.nonzero(reach)
                for at in range(0, len(i), 5000):
                    part, to = i[at : at + 5000], cell[at : at + 5000]
                    take = rows.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(own[part] == to), pa.array(d[part, to]), take.column("node"), take.column("weight"), take.column("v")], ["cell", "home", "d", "node", "weight", "v"])

    return run


def rings(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, float, float]]:
    """(cell, class of distance, rows) -> blocks (cell, block, low, high): runs of classes of about BLOCK rows; a class
    of more rows makes several blocks with the same bounds. In cells of more than MANY blocks these grow with the square
    root of the cell, up to MOST_BLOCK rows, so that a vector is copied to no more blocks than that root's share."""
    of: dict[int, int] = {}
    for c, _, n in counts:
        of[c] = of.get(c, 0) + n
    size = {c: round(min(MOST_BLOCK, BLOCK * max(1.0, math.sqrt(n / (MANY * BLOCK))))) for c, n in of.items()}
    out: list[tuple[int, int, float, float]] = []
    cell, block, low, held = None, 0, 0, 0
    todo: list[tuple[int, int, int]] = [*sorted(counts), (-1, 0, 0)]
    for (c, k, n), (after, k2, _) in zip(todo, todo[1:], strict=False):
        if c != cell:
            cell, block, low, held = c, 0, k, 0
        held += n
        if after != c or held >= size[c]:
            many = max(1, round(held / size[c]))
            # what lies between two classes that have rows belongs to none of them
            out += [(c, block + i, low * STEP, (k + 1) * STEP) for i in range(many)]
            block, low, held = block + many, k2, 0
    return out


class _Block:
    """Vectors of a block, their links by weight, and the least place of what they are connected to."""

    def __init__(self, rows: list, limit: float):
        self.node, self.weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.raw = np.array([r[2] for r in rows])
        self.unit, self.limit = _unit(self.raw), limit
        self.single = np.ascontiguousarray(self.unit.astype(np.float32).T)
        self.rough = limit - max(1e-5, 2.0**-22 * self.raw.shape[1])
        self.links, self.label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(rows), 1024):
            x = slice(i, i + 1024)
            a, b = self._near(self.raw[x], self.unit[x])
            other = a + i != b
            a, b = a[other] + i, b[other]
            self.links += np.bincount(a, self.weight[b], len(rows)).astype(np.int64)
            self._connect(np.r_[a, np.unique(a)], np.r_[b, np.unique(a)])

    def _near(self, raw: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, place in the block) with a cosine of at least the limit, by rows."""
        rough = (unit.astype(np.float32) @ self.single).ravel()
        found = np.flatnonzero(rough >= self.rough)
        keep = np.zeros(len(found), bool)
        for x in range(0, len(found), 100_000):
            i, j = np.divmod(found[x : x + 100_000], len(self.node))
            cos = np.einsum("ij,ij->i", unit[i], self.unit[j])
            ok = cos >= self.limit
            for k in np.flatnonzero(np.abs(cos - self.limit) < EDGE):
                ok[k] = exact_cosine(raw[i[k]], self.raw[j[k]]) >= self.limit
            keep[x : x + 100_000] = ok
        return np.divmod(found[keep], len(self.node))

    def _connect(self, row: np.ndarray, place: np.ndarray) -> None:
        """Places that share a row are connected."""
        if not len(row):
            return
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for x, y in zip(first, [*first[1:], len(row)], strict=True):
            if y - x > 1:
                labels = self.label[place[x:y]]
                if (labels != labels[0]).any():
                    self.label[np.isin(self.label, labels)] = labels.min()

    def stream(self, rows: list) -> None:
        raw = np.array([r[2] for r in rows])
        node, weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        i, j = self._near(raw, _unit(raw))
        self.links += np.bincount(j, weight[i], len(self.node)).astype(np.int64)
        self._connect(i, j)
        hit, first = np.unique(i, return_index=True)
        self.seen.append((node[hit], np.bincount(i, self.weight[j], len(rows)).astype(np.int64)[hit], j[first]))

    def out(self) -> pa.RecordBatch:
        node, links, root = [self.node], [self.links], [self.node[self.label]]
        for n, c, first in self.seen:
            node.append(n)
            links.append(c)
            root.append(self.node[self.label[first]])
        node, links, root = (np.concatenate(x).astype(np.int64) for x in (node, links, root))
        keep = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (node, links, root)], ["node", "links", "root"])


def _join(limit: float):
    """Rows by (cell, block), a block's own first -> (node, links, root): links by weight, and the node's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, waiting, block = None, [], [], None

        def end() -> Iterator[pa.RecordBatch]:
            made = block or (_Block(own, limit) if own else None)
            if made is not None:
                if waiting:
                    made.stream(waiting)
                yield made.out()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("cell", "block", "mine", "node", "weight", "v")]
            for cell, blk, mine, *row in zip(*cols, strict=True):
                if key != (cell, blk):
                    yield from end()
                    key, own, waiting, block = (cell, blk), [], [], None
                row[2] = np.frombuffer(row[2], "<f8")
                if mine:
                    own.append(row)
                elif own:  # a block may have no rows of its own, by chance of the hash
                    block = block or _Block(own, limit)
                    waiting.append(row)
                    if len(waiting) >= 1024:
                        block.stream(waiting)
                        waiting = []
        yield from end()

    return run


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (id, node, v): v the doubles as bytes and node their hash; both null for what can't link."""
    import xxhash

    for batch in batches:
        nodes, blobs = [], []
        for v in batch.column(1).to_pylist():
            ok = v and None not in v
            x = np.array(v, "<f8") if ok else None
            if x is None or not np.isfinite(x).all() or not x.any():
                nodes.append(None)
                blobs.append(None)
            else:
                x = x + 0.0  # one zero
                blobs.append(x.tobytes())
                nodes.append(int(np.uint64(xxhash.xxh3_64_intdigest(blobs[-1])).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["id", "node", "v"])


def cosine_components(vectors: DataFrame, limit: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: rows with a cosine of at least limit to it, the smallest id
    reachable by links, and whether that is its own."""
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = common.stage(rows.mapInArrow(_fingerprint, "id long, node long, v binary"), "range-rows")
    own = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("v").alias("v"))
    own = common.stage(own, "range-own")
    radius = math.sqrt(2 - 2 * limit)
    found = None
    for wide, n in [(r["w"], r["count"]) for r in own.groupBy(F.length("v").alias("w")).count().orderBy("w").collect()]:
        part = own.where(F.length("v") == wide).select("node", "weight", "v")
        want = max(1, min(PIVOTS, n // PER_PIVOT))
        sample = part.where(F.pmod("node", F.lit(max(1, n // (SAMPLE * want)))) == 0).select("v").limit(2 * SAMPLE * want).collect() or part.select("v").limit(1).collect()
        pivots = choose_pivots(_unit(np.array(sorted(np.frombuffer(r["v"], "<f8").tolist() for r in sample))), want, radius)
        dealt = common.stage(part.mapInArrow(_assign(pivots, radius), "cell int, home boolean, d double, node long, weight long, v binary"), "range-dealt")
        counts = dealt.where("home").groupBy("cell", F.floor(F.col("d") / STEP).cast("int").alias("k")).count().collect()  # at most PIVOTS * 2 / STEP
        blocks = spark.createDataFrame([(c, b, low - SLACK, high + SLACK) for c, b, low, high in rings([tuple(r) for r in counts])], "cell int, block int, low double, high double")
        blocks = blocks.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("block", "low", "high"))).alias("rings"))  # a row for each cell, an entry for BLOCK vectors
        blocks = common.stage(blocks, "range-blocks")
        placed = dealt.join(blocks, "cell")
        # a block's own vectors, and all that is compared with it: visitors, and its cell's vectors of earlier blocks
        home = F.filter("rings", lambda x: (x["low"] <= F.col("d")) & (F.col("d") <= x["high"]))
        placed = placed.withColumn("at", F.when(F.col("home"), F.element_at(home["block"], F.pmod(F.xxhash64("node"), F.size(home)).cast("int") + 1)).otherwise(-1))
        near = F.filter("rings", lambda x: (x["block"] >= F.col("at")) & (x["low"] <= F.col("d") + radius + SLACK) & (x["high"] >= F.col("d") - radius - SLACK))
        spread = placed.withColumn("block", F.explode(near["block"]))
        tasks = spread.select("cell", "block", (F.col("at") == F.col("block")).alias("mine"), "node", "weight", "v").repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("mine"))
        got = tasks.mapInArrow(_join(limit), "node long, links long, root long")
        found = got if found is None else found.union(got)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, root long")
    found = common.stage(found, "range-found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "range-cc")
    named = own.select("node", "weight", "least").join(links, "node", "left").join(comps, "node", "left")
    named = named.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least", F.coalesce("component", "node").alias("c"))
    named = common.stage(named, "range-named")
    # staged, so that the join deals both sides by c and a component with very many rows can be split
    least = common.stage(named.groupBy("c").agg(F.min("least").alias("component_id")), "range-least")
    result = named.join(least, "c").select("node", "n_links", "component_id")
    out = rows.drop("v").join(result, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: DuckDB SQL with the rows of cosine_components over the view embeddings: all pairs, so for small tables.
SQL = """
with recursive v as (select row_number() over () as r, cast(vec_id as bigint) as vec_id, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.r as a, b.r as b from ok a join ok b on a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
c(a, m) as (select r, vec_id from ok union select p.a, c.m from c join p on p.b = c.a)
select vec_id, coalesce(n, 0) as n_links, coalesce(m, vec_id) as component_id, coalesce(vec_id = coalesce(m, vec_id), true) as kept
from v left join (select a, min(m) as m from c group by a) x on x.a = r left join (select a, count(*) as n from p group by a) y on y.a = r"""
