"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document is its ids and an end id; one of more than `capacity` ids is cut into pieces of `capacity`, the last may
be shorter. Pieces are packed into sequences of at most `capacity` ids, as few as can be found. Only lengths matter
for that, so an individual is a list of bins, each a list of item numbers of its island.

Pieces are dealt into demes of about DEME. A deme has ISLANDS islands, each a task of its own with a population of
packings of all pieces of the deme. The first individuals are best fits in random orders, so a packing gets good by
evolution alone: a crossover puts whole well-filled bins of one parent into the other, drops there the bins that now
hold a piece twice, dissolves some others (those with room, and at times a random share of the full ones), and
best-fits the pieces displaced by that. The child replaces the worse parent if it is fitter, which means fewer bins, then
a higher mean of squared fills. After an epoch each island's elite, its best individual, migrates to the next island
of the deme; after another epoch the elites of all islands meet in one population, whose best decides. A population
that has reached the bound of the total length stops early.

Then bins that are filled up to within SLACK stay, and the pieces of all others are dealt anew, into as many demes as
they need. Where there is one deme only, all its bins stay. A round usually leaves a few poorly filled bins a deme.
Where pieces can't be combined that well, as with many copies of one document, a deme whose bins within SLACK hold
less than LEAST_DONE of its pieces settles the fuller half of its bins too. Those hold at least half of its ids, so
every round leaves less.

Every piece keeps its own row from start to end. Null text counts as empty (one sequence place, the end id); rows
that repeat an id are packed each; a very long text is many pieces. An empty table packs into nothing. Columns other
than those asked for are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common, word_bpe

#: Pieces of a deme; islands of a deme; individuals of an island at the start.
DEME, ISLANDS, POPULATION = 4096, 3, 4
#: Generations of the first epoch, of the epoch after migration, and of the elites' meeting.
GENERATIONS = (14, 10, 10)
#: A bin that lacks at most so many ids is left alone before the last round.
SLACK = 4
#: A deme that settles a smaller share of its pieces than this settles the fuller half of its bins.
LEAST_DONE = 0.125
#: Lengths are taken up to so many times longer where an order is perturbed.
PERTURBED = 3.0

#: Bins as lists of item numbers, and the room left in each.
Packing = tuple[list[list[int]], list[int]]


def best_fit(lengths: list[int], items: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Put items, in their order, each into the bin with the least room that takes it; bins and room grow."""
    by_room: dict[int, list[int]] = {}
    open_mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            open_mask |= 1 << r
    for i in items:
        n = lengths[i]
        fit = open_mask >> n
        if fit and n:
            r = n + (fit & -fit).bit_length() - 1
            at = by_room[r]
            b = at.pop()
            if not at:
                open_mask ^= 1 << r
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(capacity)
        r -= n
        room[b] = r
        if r:
            at = by_room.setdefault(r, [])
            if not at:
                open_mask |= 1 << r
            at.append(b)


def fitness(room: list[int], capacity: int) -> float:
    """Fewer bins first, then fuller ones."""
    return float(((capacity - np.array(room)) ** 2).mean()) / capacity**2 - len(room)


def crossover(lengths: list[int], into: Packing, other: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """A child of two individuals: other's fullest bins, an eighth to a half of them, go into the first. Half of the
    children also lose a random share of the first's other full bins and refit the longest displaced first; the other
    half keep them and refit in an order that is perturbed."""
    bins, room = other
    order = np.argsort(np.array(room) + rng.random(len(room)))[: max(1, int(rng.integers(len(room) // 8, len(room) // 2 + 1)))].tolist()
    taken = {i for b in order for i in bins[b]}
    # full bins are shared with the parents, nothing is put into them
    out_bins, out_room, displaced = [list(bins[b]) if room[b] else bins[b] for b in order], [room[b] for b in order], []
    wild = rng.random() < 0.5
    dissolve = rng.random(len(into[0])) < (0 if wild else rng.random())
    for b, r, gone in zip(*into, dissolve.tolist(), strict=True):
        if not taken.isdisjoint(b):
            displaced += [i for i in b if i not in taken]
        elif r or gone:
            displaced += b
        else:
            out_bins.append(b)
            out_room.append(r)
    key = np.array([lengths[i] for i in displaced]) * (rng.uniform(1, 1 + PERTURBED * rng.random(), len(displaced)) if wild else 1)
    best_fit(lengths, [displaced[k] for k in np.argsort(-key, kind="stable")], capacity, out_bins, out_room)
    return out_bins, out_room


def evolve(lengths: list[int], capacity: int, people: list[Packing], generations: int, rng: np.random.Generator) -> Packing:
    """The best individual after so many generations. people: elites that came here; best fits in random orders join
    them until there are POPULATION."""
    bound = -(-sum(lengths) // capacity)
    people = list(people)
    while len(people) < POPULATION:
        bins: list[list[int]] = []
        room: list[int] = []
        best_fit(lengths, rng.permutation(len(lengths)).tolist(), capacity, bins, room)
        people.append((bins, room))
    ranked = sorted(((fitness(p[1], capacity), p) for p in people), key=lambda x: -x[0])
    for _ in range(generations):
        if len(ranked[0][1][1]) == bound:  # no packing has fewer bins
            break
        a, b = (int(x) for x in rng.choice(len(ranked), 2, replace=False))
        child = crossover(lengths, ranked[b][1], ranked[a][1], capacity, rng)
        worse, f = max(a, b), fitness(child[1], capacity)
        if f > ranked[worse][0]:
            ranked[worse] = (f, child)
            ranked.sort(key=lambda x: -x[0])
    return ranked[0][1]


def _island(capacity: int, number: int, step: int, last: bool):
    """Rows (deme, island, lengths, elites), one for each island, or for each deme at the elites' meeting (step 2); an
    elite is the bin of each item. Gives (deme, island, lengths, bins) with the best individual; at the meeting (deme,
    sequences, offsets), sequence -1 for the items that go on."""

    def best(deme: int, island: int, lengths: list[int], elites: list) -> Packing:
        people = []
        for at in elites:
            bins: list[list[int]] = [[] for _ in range(max(at) + 1)]
            for i, b in enumerate(at):
                bins[b].append(i)
            people.append((bins, [capacity - sum(lengths[i] for i in b) for b in bins]))
        return evolve(lengths, capacity, people, GENERATIONS[step], np.random.default_rng([number, step, deme, island]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("packing")
        for batch in batches:
            for x in range(batch.num_rows):
                deme, island, lengths, elites = (c[x].as_py() for c in batch.columns)
                bins, room = best(deme, island, lengths, elites)
                n = len(lengths)
                if step < 2:
                    where = np.empty(n, np.int32)
                    for b, items in enumerate(bins):
                        where[items] = b
                    yield pa.RecordBatch.from_arrays([pa.array([deme]), pa.array([island], pa.int32()), pa.array([lengths], pa.list_(pa.int32())), pa.array([where])], ["deme", "island", "lengths", "bins"])
                    continue
                sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
                stay = {b for b, r in enumerate(room) if last or r <= SLACK}
                if sum(len(bins[b]) for b in stay) < LEAST_DONE * n:
                    stay.update(sorted(range(len(room)), key=room.__getitem__)[: -(-len(room) // 2)])
                for b in stay:
                    at = 0
                    for i in bins[b]:
                        sequence[i], offset[i] = (number << 56) | (deme << 16) | b, at
                        at += lengths[i]
                yield pa.RecordBatch.from_arrays([pa.array([deme]), pa.array([sequence]), pa.array([offset])], ["deme", "sequences", "offsets"])

    return run


_ELITE, _DECIDED = "deme long, island int, lengths array<int>, bins array<int>", "deme long, sequences array<long>, offsets array<long>"


def pieces(docs: DataFrame, vocabulary: str, end: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces of all rows."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("word_bpe", word_bpe.word_coder.cache_clear)
        for batch in batches:
            key = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, ids in word_bpe.encoded(batch.column(1).to_pylist(), vocabulary, end):
                for k, x in enumerate(range(0, len(ids), capacity)):
                    part = ids[x : x + capacity]
                    for to, v in zip(out, (key[i], k, x, len(part), zlib.crc32(part.tobytes())), strict=True):
                        to.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """rows: (doc_id, piece, start, length, ids_crc32), each length from 1 to capacity; adds sequence_id and offset.

    A deme's pieces are one row, an array of about DEME small structs, and an individual is an array of bin numbers;
    islands and migration move only lengths and individuals."""
    spark = rows.sparkSession
    common.ship(spark)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    todo = common.stage(rows.select(*names), "pack-pieces")
    done, number = [], 1
    while True:
        demes = max(1, -(-todo.count() // DEME))
        tasks = min(demes * ISLANDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), demes * ISLANDS // 32))
        # pieces are known and dealt by their place in the staged table: no key can gather many of them
        dealt = todo.withColumn("k", F.monotonically_increasing_id()).withColumn("deme", F.pmod(F.xxhash64("k"), F.lit(demes)))
        items = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("n"), "k", *names)))
        held = common.stage(dealt.groupBy("deme").agg(items.alias("items")), "pack-demes")
        lengths = F.transform("items", lambda x: x["length"].cast("int")).alias("lengths")
        none = F.array().cast("array<array<int>>").alias("elites")
        islands = held.select("deme", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), lengths, none).repartition(tasks, "deme", "island")
        first = common.stage(islands.mapInArrow(_island(capacity, number, 0, False), _ELITE), "pack-elites")
        # each elite stays at home and goes to the next island
        moved = first.withColumn("to", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)))
        moved = moved.groupBy("deme", "to").agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_list(F.struct("island", "bins")))["bins"].alias("elites"))
        second = common.stage(moved.repartition(tasks, "deme", "to").mapInArrow(_island(capacity, number, 1, False), _ELITE), "pack-elites")
        met = second.groupBy("deme").agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_list(F.struct("island", "bins")))["bins"].alias("elites"))
        met = met.select("deme", F.lit(ISLANDS).alias("island"), "lengths", "elites").repartition(min(tasks, demes), "deme")
        decided = met.mapInArrow(_island(capacity, number, 2, demes == 1), _DECIDED)
        placed = held.join(decided, "deme").select(F.inline(F.transform("items", lambda x, i: F.struct(*[x[c].alias(c) for c in names], F.get("sequences", i).alias("sequence_id"), F.get("offsets", i).alias("offset")))))
        packed = common.stage(placed, "pack-round")
        for table in (held, first, second):
            common.unstage(table)
        done.append(packed.where("sequence_id >= 0"))
        if demes == 1:
            break
        todo = packed.where("sequence_id < 0").select(*names)
        number += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all rows of docs."""
    return pack(pieces(docs, vocabulary, end, capacity, id_col, text_col), capacity)
