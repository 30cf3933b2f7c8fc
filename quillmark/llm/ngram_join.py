"""N-gram Jaccard self-join by PartEnum signatures.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a document's set holds its distinct 5-word
shingles (the whole sequence as one where it has fewer words, nothing where it has no word). Two documents link
where |A & B| >= 0.75 |A | B|, so that |A ^ B| <= (|A| + |B|) / 7.

PartEnum: sizes fall into bands whose ends differ by the factor 0.75, so linked sets lie in the same or in
neighbouring bands, and each set takes part in its own band and in the next one. For a band whose largest size is
r, the feature domain (64-bit shingle hashes) is split into n1 > k = 2r/7 ranges. Linked sets differ in at most k
features, so they agree on at least n1 - k ranges: the signature of a range is a hash of the features a set has in
it, and linked sets share one. Ranges in which a set has no feature are left out where the set has fewer than
n1 - k of them (then at least one shared range isn't empty); the other sets keep them all. Nothing is lost.

Buckets of equal signatures are joined without emitting their pairs: first each member with the bucket's hub only.
Candidates pass two exact tests: sizes, and parity sketches (the parities of the counts of features in 2^j classes
differ in at most |A ^ B| places); survivors are verified on whole sets, one partner of each node first. Links
are contracted to components, and only buckets that still hold several components are looked at again, member against
member of another component, by sketches inside the bucket. A task gives a forest of the candidate pairs it finds, the groups
that these forests connect get their whole sets together, and links are sought in them, block against block; so no
step makes rows for all pairs. Links between members of one component can't change the result.

Of buckets with more than SMALL nodes (a passage that many documents share), only those members are looked at again
that a small bucket may not have served: linked sets agree on n1 - k ranges, so if fewer of a set's ranges are empty
or lie in large buckets, it shares a small bucket with each partner. What is left of a large bucket is dealt in
blocks, so no task holds a whole one. Pairs of two lower members are found in their own band and skipped.

A node is a 64-bit hash of a set; documents with equal sets are one node. Two different sets get one hash with
probability 2^-64 a pair; then they count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common

#: Fixed by the contract: words in a shingle; a link has 100 * intersection >= 75 * union.
WIDTH, NUM, DEN = 5, 75, 100
#: Ranges for each difference that linked sets may have.
SPARE = 1.15
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Buckets of more nodes are large.
SMALL = 32
#: Partners that a node's set is compared with in one go.
PARTNERS = 256
#: Bytes of text for each part of the signatures; signatures of a part that are sorted at once.
PART, SORTED = 64 << 20, 1_000_000
#: Times as many classes of a sketch where nodes of one bucket are compared.
WIDE = 4
#: Nodes that a task remembers so as to make their signatures once.
SEEN = 400_000

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[4]
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64 for an odd B, and the inverses."""
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random number for each byte; 0 for white space.
_BYTE = np.array([0 if b in b" \t\n\v\f\r" else int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") | 1 for b in range(256)], np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
#: Bytes of text that are hashed in one go; longer texts take a run of their own.
CHUNK = 1 << 18
_tables: dict[str, np.ndarray] = {}


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, 64-bit hashes) of the words in data, which ends with white space."""
    if len(_tables.get("up", ())) <= len(data):
        n = max(len(data), CHUNK)
        with np.errstate(over="ignore"):
            _tables["up"] = _powers(n)
            _tables["down"] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
    value = _BYTE[data]
    word = value != 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.r_[0, edge]
    start, stop = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.cumsum(value * _tables["up"][: len(data)])
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        return start, mix((total[stop - 1] - before) * _tables["down"][start] + (stop - start).astype(np.uint64))


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(all sets one behind the other, size of each text's set): sorted distinct 64-bit hashes of the shingles."""
    flat, sizes, i = [], [], 0
    while i < len(texts):
        held, chunk = 0, []
        while i < len(texts) and (not chunk or held < CHUNK):
            chunk.append((texts[i] or "").encode("utf-8", "surrogatepass"))
            held += len(chunk[-1]) + 1
            i += 1
        stops = np.cumsum([len(c) + 1 for c in chunk])
        start, h = _words(np.frombuffer(b" ".join(chunk) + b" ", np.uint8))
        last = np.searchsorted(start, stops)  # words of the texts up to each
        count = np.diff(last, prepend=0)
        with np.errstate(over="ignore"):
            x = h[: max(0, len(h) - WIDTH + 1)].copy()
            for j in range(1, WIDTH):
                x = x * _K[0] + h[j : j + len(x)]
        x = mix(x)
        for end, n in zip(last.tolist(), count.tolist(), strict=True):
            if n >= WIDTH:
                own = np.sort(x[end - n : end - WIDTH + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif n:
                own = np.array([n], np.uint64)
                with np.errstate(over="ignore"):
                    for y in h[end - n : end]:
                        own = mix(own * _K[0] + y)
            else:
                own = h[:0]
            flat.append(own)
            sizes.append(len(own))
    return np.concatenate(flat) if flat else np.empty(0, np.uint64), np.array(sizes, np.int64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return shingle_sets([text])[0]


def node_of(s: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number; 0 for the empty set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64)) if len(s) else 0


def sketch_bytes(n: int) -> int:
    """Bytes of the sketch of a set of n features: at least one bit each, a power of two."""
    return max(8, 1 << max(0, int(n - 1).bit_length() - 3))


def sketch(s: np.ndarray, times: int = 1) -> bytes:
    bits = sketch_bytes(len(s)) * 8 * times
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches made as short as width bytes: classes are merged, so parities add."""
    while x.shape[-1] > width:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _bands(top: int) -> np.ndarray:
    """First sizes of the bands up to that of size top, and of those behind it."""
    lo = [1]
    while lo[-1] <= top:
        lo.append(lo[-1] * DEN // NUM + 1)
    for _ in range(2):
        lo.append(lo[-1] * DEN // NUM + 1)
    return np.array(lo)


def _band(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.searchsorted(lo, size, side="right") - 1


def signatures(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, index of the set of each, spare[step, set]) of sorted, nonempty sets that lie one behind the
    other in flat. Step 0 is a set's own band, where it is an upper member, step 1 the next, where it is a lower
    one. The lowest bit of a signature is that of its band's number. spare: how many ranges that linked partners
    agree on are neither empty nor otherwise accounted for, at least."""
    lo = _bands(int(size.max()))
    band = _band(lo, size)
    out, at, spare = [], [], np.zeros((2, len(size)), np.int64)
    mixed, high, ends = mix(flat), flat >> np.uint64(32), np.cumsum(size)
    with np.errstate(over="ignore"):
        for step in (0, 1):
            j = band + step
            top, under = lo[j + 1] - 1, lo[j] - 1
            k = 2 * top // 7
            n1 = np.ceil(SPARE * k + 1).astype(np.int64)
            agree = n1 - (k if step == 0 else (top + under) // 7)
            p = (high * np.repeat(n1.astype(np.uint64), size)) >> np.uint64(32)
            new = np.empty(len(p), bool)
            new[0] = True
            np.not_equal(p[1:], p[:-1], out=new[1:])
            new[ends[:-1]] = True
            first = np.flatnonzero(new)
            d, q = np.searchsorted(ends, first, side="right"), p[first]
            parity = (j & 1).astype(np.uint64)
            sig = mix(np.add.reduceat(mixed, first) + q * _K[2] + j[d].astype(np.uint64) * _K[1])
            out.append((sig & ~np.uint64(1)) | parity[d])
            at.append(d)
            empty = n1 - np.bincount(d, minlength=len(size))
            spare[step] = agree - empty
            for i in np.flatnonzero(spare[step] <= 0):
                lack = np.ones(int(n1[i]), bool)
                lack[q[np.searchsorted(d, i) : np.searchsorted(d, i, side="right")].astype(np.int64)] = False
                missing = np.flatnonzero(lack).astype(np.uint64)
                out.append((mix(missing * _K[2] + np.uint64(j[i]) * _K[1]) & ~np.uint64(1)) | parity[i])
                at.append(np.full(len(missing), i))
    return np.concatenate(out), np.concatenate(at), spare


_TYPES = {"part": pa.int32(), "kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int32(), "blob": pa.binary()}
_ROW = "kind int, a long, b long, n int, blob binary"


def _rows(kind: int, a=None, b=None, n=None, blob=None, part=None) -> pa.RecordBatch:
    got = {"a": a, "b": b, "n": n, "blob": blob, "part": part}
    m = len(next(v for v in got.values() if v is not None))
    got = {k: pa.nulls(m, _TYPES[k]) if v is None else pa.array(v, _TYPES[k]) for k, v in got.items()} | {"kind": pa.array(np.full(m, kind, np.int32))}
    names = (["part"] if part is not None else []) + ["kind", "a", "b", "n", "blob"]
    return pa.RecordBatch.from_arrays([got[k] for k in names], names)


def _emit(parts: int):
    """Documents -> for each part: packed signatures (kind 0), sketches (1) and wide ones (8), documents
    (4), spares (7)."""

    def flush(ids: list, nodes: list[int], sizes: list[int], hashes: list[int], own: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node = np.array(nodes, np.int64)
        yield _rows(4, node, ids, sizes, [b"%d" % h for h in hashes], part=(node % parts).astype(np.int32))
        if not sets:
            return
        node, size = np.array(own, np.int64), np.array([len(s) for s in sets], np.int64)
        part = (node % parts).astype(np.int32)
        yield _rows(1, node, n=size, blob=[sketch(s) for s in sets], part=part)
        yield _rows(8, node, n=size, blob=[sketch(s, WIDE) for s in sets], part=part)
        sig, at, spare, i = [], [], [], 0
        while i < len(sets):  # a few sets at a time stay in the processor's cache
            j, held = i, 0
            while j < len(sets) and held < CHUNK // 4:
                held += len(sets[j])
                j += 1
            s, a, e = signatures(np.concatenate(sets[i:j]), size[i:j])
            sig.append(s)
            at.append(a + i)
            spare.append(e)
            i = j
        sig, at, spare = np.concatenate(sig), np.concatenate(at), np.concatenate(spare, axis=1)
        for step in (0, 1):
            yield _rows(7, node, np.full(len(node), step), spare[step].astype(np.int32), part=part)
        to = ((sig >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int32)
        order = np.argsort(to, kind="stable")
        sig, at, to = sig[order], at[order], to[order]
        low = np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :5])
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        blobs, counts = [], []
        for x, y in zip(cut, [*cut[1:], len(to)], strict=True):
            here, local = np.unique(at[x:y], return_inverse=True)
            blobs.append(node[here].tobytes() + size[here].astype(np.int32).tobytes() + local.astype(np.uint16).tobytes() + low[x:y].tobytes())
            counts.append(len(here))
        for x in range(0, len(blobs), 1000):
            yield _rows(0, n=counts[x : x + 1000], blob=blobs[x : x + 1000], part=to[cut[x : x + 1000]].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("ngram_join", _tables.clear)
        seen: set[int] = set()
        held: tuple[list, ...] = ([], [], [], [], [], [])
        weight = 0
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                rows = batch.slice(x, 500)
                flat, size = shingle_sets(rows.column(1).to_pylist())
                stop = np.cumsum(size)
                for i, h, n, e in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), size.tolist(), stop.tolist(), strict=True):
                    s = flat[e - n : e]
                    node = node_of(s)
                    for v, to in zip((i, node, n, h), held, strict=False):
                        to.append(v)
                    if n and i is not None and node not in seen:
                        if len(seen) < SEEN:
                            seen.add(node)
                        held[4].append(node)
                        held[5].append(s)
                        weight += n
                if weight > 2_000_000 or len(held[5]) >= 60_000 or len(held[0]) >= 200_000:
                    yield from flush(*held)
                    weight = 0
                    for v in held:
                        v.clear()
        if held[0]:
            yield from flush(*held)

    return run


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed signatures of whole parts -> what _buckets makes of them; other kinds pass through. A part is held
    packed and sorted a slice at a time, about SORTED signatures, chosen by bits of the signature."""
    common.only("ngram_join", _tables.clear)
    held: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        rest = np.flatnonzero(kind != 0)
        if len(rest):
            yield batch.take(pa.array(rest)).select(["kind", "a", "b", "n", "blob"])
        for i in np.flatnonzero(kind == 0):
            held.setdefault(batch.column("part")[i].as_py(), []).append((batch.column("n")[i].as_py(), batch.column("blob")[i].as_py()))
    for blobs in held.values():
        slices = 1 + sum((len(b) - 12 * n) // 7 for n, b in blobs) // SORTED
        for x in range(slices):
            sig, node, size = [], [], []
            for n, blob in blobs:
                m = (len(blob) - 12 * n) // 7
                low = np.zeros((m, 8), np.uint8)
                low[:, :5] = np.frombuffer(blob, np.uint8, 5 * m, 12 * n + 2 * m).reshape(m, 5)
                s, local = low.view(np.uint64).ravel(), np.frombuffer(blob, np.uint16, m, 12 * n)
                if slices > 1:
                    mine = (s >> np.uint64(4)) % np.uint64(slices) == x
                    s, local = s[mine], local[mine]
                sig.append(s)
                node.append(np.frombuffer(blob, np.int64, n)[local])
                size.append(np.frombuffer(blob, np.int32, n, 8 * n)[local])
            yield from _buckets(*(np.concatenate(c) for c in (sig, node, size)))


def _buckets(s: np.ndarray, v: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signatures, their nodes and sizes -> candidate pairs with a bucket's hub, its smallest upper node (kind 2);
    buckets of three or more nodes, small (3) and large (5); how many large buckets a (node, step) is in (6). A bucket
    without upper members has nothing to find."""
    import xxhash

    order = np.argsort(s, kind="stable")
    t = s[order]
    same = t[1:] == t[:-1]
    order = order[np.r_[False, same] | np.r_[same, False]]  # without what is alone
    s, v, n = s[order], v[order], n[order]
    order = np.lexsort((v, s))
    s, v, n = s[order], v[order], n[order]
    new = np.r_[True, s[1:] != s[:-1]][: len(s)]
    keep = new | np.r_[True, v[1:] != v[:-1]][: len(s)]  # a node once in each bucket
    s, v, n, new = s[keep], v[keep], n[keep], new[keep]
    if not len(s):
        return
    lower = ((_band(_bands(int(n.max())), n) & 1) != (s & np.uint64(1)).astype(np.int64)).astype(np.uint8)
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(s)])
    place = np.where(lower == 0, np.arange(len(s)), len(s))
    hub = np.minimum.reduceat(place, first)
    some = hub < len(s)
    at = np.repeat(np.where(some, hub, 0), count)
    here = np.flatnonzero(np.repeat(some, count) & (at != np.arange(len(s))))
    small, large = np.minimum(n[here], n[at[here]]).astype(np.int64), np.maximum(n[here], n[at[here]]).astype(np.int64)
    here = here[DEN * small >= NUM * large]
    if len(here):
        pairs = np.unique(np.stack([np.minimum(v[at[here]], v[here]), np.maximum(v[at[here]], v[here])], 1), axis=0)
        for x in range(0, len(pairs), 50_000):
            y = pairs[x : x + 50_000]
            yield _rows(2, np.ascontiguousarray(y[:, 0]), np.ascontiguousarray(y[:, 1]))
    for kind, of in ((3, some & (count > 2) & (count <= SMALL)), (5, some & (count > SMALL))):
        lists = list({v[x : x + c].tobytes() + lower[x : x + c].tobytes() for x, c in zip(first[of], count[of], strict=True)})
        for x in range(0, len(lists), 5000):
            y = lists[x : x + 5000]
            name = np.array([xxhash.xxh3_64_intdigest(b) for b in y], np.uint64).astype(np.int64)
            yield _rows(kind, name, n=[len(b) // 9 for b in y], blob=y)
        if kind == 5 and of.any():
            at = np.repeat(of, count)
            for step in (0, 1):
                who, often = np.unique(v[at & (lower == step)], return_counts=True)
                yield _rows(6, who, np.full(len(who), step), often.astype(np.int32))


def _near(xa: list[bytes], xb: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which pairs of sketches may belong to linked sets."""
    ok = np.zeros(len(xa), bool)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(xa, xb, strict=True)):
        groups.setdefault((len(a), len(b)), []).append(i)
    for (p, q), at in groups.items():
        a = np.frombuffer(b"".join([xa[i] for i in at]), np.uint64).reshape(-1, p // 8)
        b = np.frombuffer(b"".join([xb[i] for i in at]), np.uint64).reshape(-1, q // 8)
        w = min(p, q) // 8
        ok[at] = np.bitwise_count(fold(a, w) ^ fold(b, w)).sum(1, dtype=np.int64) <= (na[at].astype(np.int64) + nb[at]) // 7
    return ok


def _sketch_test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        ok = _near(x.column("xa").to_pylist(), x.column("xb").to_pylist(), x.column("na").to_numpy(), x.column("nb").to_numpy())
        yield x.select(["a", "b"]).filter(pa.array(ok))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, chunk, b, blob) by a and chunk, b null for the set of a itself, first: links (a, b)."""
    at, base = None, None
    for x in batches:
        out_a, out_b = [], []
        for a, b, blob in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), x.column("blob").to_pylist(), strict=True):
            s = np.frombuffer(blob, np.uint64)
            if b is None:
                at, base = a, s
                continue
            assert a == at, "a candidate's set is missing"
            both = len(base) + len(s) - len(np.union1d(base, s)) if len(base) < 64 else int(np.isin(s, base, assume_unique=True, kind="sort").sum())
            if DEN * both >= NUM * (len(base) + len(s) - both):
                out_a.append(a)
                out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for i in range(0, x.num_rows, 500):
            y = x.slice(i, 500)
            flat, size = shingle_sets(y.column("text").to_pylist())
            stop = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([y.column("node"), pa.array([flat[e - n : e].tobytes() for n, e in zip(size, stop, strict=True)], pa.binary())], ["node", "blob"])


def _sets_of(nodes: DataFrame, docs: DataFrame, first: DataFrame, name: str) -> DataFrame:
    """(node, blob) with the set of each of the distinct nodes, once. An id may have several texts, so a text is known
    by its id and its hash."""
    need = nodes.join(first, "node")
    texts = docs.join(need, (docs["__id"] == need["doc"]) & (docs["__hash"] == need["hash"])).dropDuplicates(["__id", "__hash"])
    return common.stage(texts.select("node", "text").mapInArrow(_sets, "node long, blob binary"), name)


def _verified(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Links among candidate pairs (a, b) of nodes, staged; first: (node, doc, hash) with one document of each node.
    Partners of a node are dealt in chunks of about PARTNERS, each with the node's own set."""
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, first, "join-sets")
    many = common.stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("chunks")).where("chunks > 1"), "join-many")
    dealt = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "chunks"), F.lit(0)).alias("chunk"))
    mine = dealt.select("a", "chunk").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "blob")
    other = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "blob")
    both = mine.union(other).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    out = common.stage(both.mapInArrow(_verify, "a long, b long"), "join-links")
    common.unstage(sets)
    common.unstage(many)
    return out


class Forest:
    """Disjoint sets; join() tells whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of block pairs, sorted by (bucket, x, y) -> a forest that connects what candidate pairs across components
    connect."""

    def pairs(rows: list[list], diagonal: bool) -> np.ndarray | None:
        left = [r for r in rows if r[0] != 1]
        right = left if diagonal else [r for r in rows if r[0] == 1]
        if not left or not right:
            return None
        w = min(len(r[5]) for r in rows)
        sk = lambda rs: np.concatenate([fold(np.frombuffer(r[5], np.uint64), w // 8)[None] for r in rs])
        a, b = sk(left), sk(right)
        (va, ca, na, la), (vb, cb, nb, lb) = ([np.array([r[i] for r in rs], np.int64) for i in (1, 2, 3, 4)] for rs in (left, right))
        out = []
        step = max(1, (1 << 20) // (len(right) * w))
        for x in range(0, len(left), step):
            y = slice(x, x + step)
            n, m = na[y, None], nb[None]
            ok = (ca[y, None] != cb[None]) & (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & ~((la[y, None] & lb[None]) == 1)
            if diagonal:
                ok &= np.arange(len(left))[y, None] < np.arange(len(right))[None]
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            diff = np.bitwise_count(a[y][i] ^ b[j]).sum(1, dtype=np.int64)
            limit = (na[y][i] + nb[j]) // 7
            near = diff <= limit
            i, j, diff, limit = i[near], j[near], diff[near], limit[near]
            out.append(np.stack([np.minimum(va[y][i], vb[j]), np.maximum(va[y][i], vb[j])]))
        if not out:
            return None
        return np.concatenate(out, axis=1)

    key, rows, found, held, forest = None, [], [], 0, Forest()

    def flush() -> pa.RecordBatch:  # what the task has connected before goes no further
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        found.clear()
        both = both[:, [forest.join(a, b) for a, b in both.T.tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in both], ["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "x", "y", "side", "node", "comp", "n", "lower", "blob")]
        for bucket, x, y, *row in zip(*cols, strict=True):
            if key != (bucket, x, y):
                if rows and (out := pairs(rows, key[1] == key[2])) is not None:
                    found.append(out)
                    held += out.shape[1]
                    if held > 1_000_000:
                        yield flush()
                        held = 0
                key, rows = (bucket, x, y), []
            rows.append(row)
    if rows and (out := pairs(rows, key[1] == key[2])) is not None:
        found.append(out)
    if found:
        yield flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        blobs = x.column(1).to_pylist()
        size = np.array([len(b) // 9 for b in blobs], np.int64)
        if not len(blobs):
            continue
        v = np.concatenate([np.frombuffer(b, np.int64, n) for b, n in zip(blobs, size, strict=True)])
        low = np.concatenate([np.frombuffer(b, np.uint8, n, 8 * n) for b, n in zip(blobs, size, strict=True)])
        bucket = np.repeat(x.column(0).to_numpy(), size)
        for i in range(0, len(v), 100_000):
            y = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[y]), pa.array(v[y]), pa.array(low[y].astype(np.int32))], ["bucket", "node", "lower"])


def _group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of block pairs, sorted by (grp, x, y), with whole sets -> a forest of links across components."""
    key, rows = None, []

    def links(diagonal: bool) -> list[tuple[int, int]]:
        left = [r for r in rows if r[0] != 1]
        right = left if diagonal else [r for r in rows if r[0] == 1]
        if not left or not right:
            return []
        out, forest = [], Forest()
        for r in {r[1]: r for r in rows}.values():
            forest.join(r[1], r[2])  # a node and its component
        sets = {r[1]: np.frombuffer(r[3], np.uint64) for r in rows}
        w = 8 * min(sketch_bytes(len(x)) * WIDE // 8 for x in sets.values())
        brief = {v: fold(np.frombuffer(sketch(x, WIDE), np.uint64), w // 8) for v, x in sets.items()}
        b = np.stack([brief[r[1]] for r in right])
        m = np.array([len(sets[r[1]]) for r in right])
        for i, r in enumerate(left):
            x = sets[r[1]]
            n = len(x)
            ok = (np.bitwise_count(brief[r[1]] ^ b).sum(1, dtype=np.int64) <= (n + m) // 7) & (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m))
            for j in np.flatnonzero(ok):
                if diagonal and j <= i or forest.find(r[1]) == forest.find(right[j][1]):
                    continue
                y = sets[right[j][1]]
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                if DEN * both >= NUM * (n + len(y) - both):
                    forest.join(r[1], right[j][1])
                    out.append((r[1], right[j][1]))
        return out

    def batch_of(pairs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("grp", "x", "y", "side", "node", "comp", "blob")]
        for grp, x, y, *row in zip(*cols, strict=True):
            if key != (grp, x, y):
                if rows:
                    yield batch_of(links(key[1] == key[2]))
                key, rows = (grp, x, y), []
            rows.append(row)
    if rows:
        yield batch_of(links(key[1] == key[2]))


def _block_pairs(members: DataFrame, group: str, cols: tuple[str, ...], size: int, load: DataFrame) -> DataFrame:
    """members, dealt in blocks of about size, with each block met by each other of its group: rows
    (group, x, y, side, cols, columns of load), side 2 within one block, 0 and 1 for the two of a pair. What a node
    brings along (load) joins after the blocks are made, so it is dealt once."""
    many = members.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("nb"))
    named = members.join(many, group).withColumn("blk", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    one = named.select(group, F.col("blk").alias("x"), F.col("blk").alias("y"), F.lit(2).alias("side"), *cols)
    more = named.where("nb > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).where("o <> blk")
    more = more.select(group, F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), F.when(F.col("blk") < F.col("o"), 0).otherwise(1).alias("side"), *cols)
    return one.union(more).join(load, "node").repartition(group, "x", "y").sortWithinPartitions(group, "x", "y")


def _verified_groups(groups: DataFrame, comps: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Links across components within groups of nodes that candidate pairs connect. Whole sets go to the tasks, a
    block against a block, and a task gives no more links than it needs to connect what they connect."""
    named = groups.select("node", F.col("component").alias("grp")).join(comps, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("comp"))
    sets = _sets_of(named.select("node"), docs, first, "join-group-sets")
    dealt = _block_pairs(named, "grp", ("node", "comp"), max(1, BLOCK // 4), sets)
    out = common.stage(dealt.mapInArrow(_group_blocks, "a long, b long"), "join-links")
    common.unstage(sets)
    return out


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    ca, cb = (comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    named = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _across(members: DataFrame, comps: DataFrame, sketches: DataFrame) -> DataFrame:
    """Forests of the candidate pairs of nodes of different components that share a bucket."""
    named = members.join(comps, "node", "left").select("bucket", "node", "lower", F.coalesce("component", "node").alias("comp"))
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
    named = common.stage(named.join(mixed, "bucket"), "join-mixed")
    dealt = _block_pairs(named, "bucket", ("node", "comp", "lower"), BLOCK, sketches)
    return dealt.mapInArrow(_blocks, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs, component_id the smallest id reachable by links.

    Null or wordless texts have no shingles and link with nothing; a null id takes no part and gets a null
    component; rows that repeat an id each count (the id's rows are the ids' texts). Empty input gives no rows.
    Very long texts have large sets, compared whole. Other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("__hash"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = common.parts_for(spark, total, PART)
    emitted = docs.mapInArrow(_emit(parts), "part int, kind int, a long, b long, n int, blob binary")
    found = common.stage(emitted.repartitionById(parts, "part").mapInArrow(_bucket, "kind int, a long, b long, n int, blob binary"), "join-found", ["kind"])
    of = lambda k: found.where(F.col("kind") == k)
    own = of(4).select(F.col("a").alias("node"), F.col("b").alias("id"), F.col("n").alias("n_shingles"), F.col("blob").cast("string").cast("long").alias("hash"))
    sketches = of(1).select(F.col("a").alias("node"), "n", "blob").dropDuplicates(["node"])
    first = own.where("n_shingles > 0 and id is not null").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("m")).select("node", F.col("m.id").alias("doc"), F.col("m.hash").alias("hash"))
    sa, sb = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("blob").alias(f"x{c}")) for c in "ab")
    texts = docs.where("__id is not null")
    near = common.stage(of(2).select("a", "b").distinct().join(sa, "a").join(sb, "b").mapInArrow(_sketch_test, "a long, b long"), "join-near")
    # first one partner of each node; what that joins needs no further test
    some = common.stage(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "join-some")
    links = _verified(some, texts, first)
    comps = components_of(links)
    others = common.stage(_apart(near.join(some, ["a", "b"], "left_anti"), comps), "join-others")
    links = links.union(_verified(others, texts, first))
    comps = components_of(links)
    listed = lambda k: of(k).dropDuplicates(["a"]).select("a", "blob").mapInArrow(_members, "bucket long, node long, lower int")
    spare = of(7).groupBy("a", "b").agg(F.min("n").alias("spare"))
    heavy = of(6).groupBy("a", "b").agg(F.sum("n").alias("large")).join(spare, ["a", "b"]).where("large >= spare").select(F.col("a").alias("node"), F.col("b").cast("int").alias("lower"))
    members = common.stage(listed(3).union(listed(5).join(heavy, ["node", "lower"]).select("bucket", "node", "lower")), "join-members")
    wide = of(8).select(F.col("a").alias("node"), "n", "blob").dropDuplicates(["node"])
    groups = common.components(_across(members, comps, wide), "join-groups")
    links = links.union(_verified_groups(groups, comps, texts, first))
    comps = components_of(links)
    named = own.join(comps, "node", "left").select("id", "n_shingles", F.coalesce("component", "node").alias("c"))
    # staged, so that the join deals both sides by c and a component with very many rows can be split
    least = common.stage(named.where("n_shingles > 0").groupBy("c").agg(F.min("id").alias("least")), "join-least")
    out = named.where("n_shingles > 0").join(least, "c").select("id", "n_shingles", F.col("least").alias("component_id"))
    alone = named.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def components_of(links: DataFrame) -> DataFrame:
    return common.components(links, "join-cc")


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id: one document of each near-duplicate group stays.

    Rows with a null id stay, and so do all rows that have the id of the one that stays. Null and wordless texts are
    alone. An empty table gives no rows. All columns of docs are kept as they are, whatever their names."""
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # any names can stand in docs
    key = f"c{names.index(id_col)}"
    comp = jaccard_components(docs, id_col, text_col)
    gone = common.stage(comp.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("gone")).distinct(), "join-gone")
    return rows.join(gone, rows[key] == gone["gone"], "left_anti").toDF(*names)


#: DuckDB SQL with the rows of jaccard_components over the view documents; pairs come from shared shingles.
SQL = r"""
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select r, doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as g from w),
n as (select r, doc_id, cast(len(g) as bigint) as n_shingles from s),
f as (select r, md5(unnest(g)) as h from s where doc_id is not null),
p as (select a, b from (select x.r as a, y.r as b, count(*) as c from f x join f y on x.h = y.h and x.r < y.r group by all) join n na on na.r = a join n nb on nb.r = b where 100 * c >= 75 * (na.n_shingles + nb.n_shingles - c)),
e as (select a, b from p union all select b, a from p),
c(a, m) as (select r, doc_id from n where doc_id is not null union select e.a, c.m from c join e on e.b = c.a)
select doc_id, n_shingles, component_id from n left join (select a, min(m) as component_id from c group by a) on a = r"""
