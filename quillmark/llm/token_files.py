"""Token-id shards: documents compressed one by one with a shared zstandard dictionary.

A folder holds `dictionary` and one shard file for each range of ids. A shard is

    magic "QMTOK1\\0\\0" | sha256 of the dictionary | one zstandard frame for each document | index | footer

where the index has, for each document in ascending id order, (id, id is null, offset of its frame, tokens before
it in the shard, tokens) as little-endian 64-bit numbers, and the footer the index's offset and row count. A reader
checks the dictionary's hash and reaches one document by its index row, without the others. Frames hold ids as
16-bit numbers where all fit, else 32-bit; the first byte of the content says which.

Shards are written under a name of the attempt and renamed, so a task that runs again (a lost executor, or
speculation) puts the same content in the same place.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common, word_bpe

MAGIC = b"QMTOK1\0\0"
HEAD = len(MAGIC) + 32
LEVEL = 3
#: The dictionary is fit on at most so many documents of at most so many bytes; its size in bytes.
FIT_ROWS, FIT_BYTES, DICT_SIZE = 1000, 16_000, 64 << 10
#: Bytes of text for each shard.
SHARD_BYTES = 64 << 20


class Store:
    """Files of a folder given by a URI: local and shared disks directly, other stores by pyarrow."""

    def __init__(self, uri: str):
        if uri.startswith("file:") or "://" not in uri:
            self._fs, self.root = None, "/" + uri.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self._fs, self.root = fs.FileSystem.from_uri(uri)

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        path = posixpath.join(self.root, name)
        if self._fs is None:
            with open(path, "rb") as f:
                f.seek(start)
                return f.read() if size is None else f.read(size)
        with self._fs.open_input_file(path) as f:
            f.seek(start)
            return f.read() if size is None else f.read(size)

    def size(self, name: str) -> int:
        path = posixpath.join(self.root, name)
        return os.path.getsize(path) if self._fs is None else self._fs.get_file_info(path).size

    def write(self, name: str, chunks: Iterator[bytes]) -> None:
        path, part = posixpath.join(self.root, name), posixpath.join(self.root, f".{name}.{uuid.uuid4().hex}")
        if self._fs is None:
            os.makedirs(self.root, exist_ok=True)
            with open(part, "wb") as f:
                for c in chunks:
                    f.write(c)
            os.replace(part, path)
            return
        with self._fs.open_output_stream(part) as f:
            for c in chunks:
                f.write(c)
        if self._fs.get_file_info(path).type.name != "NotFound":
            self._fs.delete_file(path)
        self._fs.move(part, path)


def pack(ids: np.ndarray) -> bytes:
    return b"\1" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\0" + ids.astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] else "<u4", offset=1).astype("<u4")


def train(samples: list[bytes], size: int = DICT_SIZE) -> bytes:
    """A dictionary for serialized id arrays; raw content where there is too little to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (z.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"\0" * 16


def _dictionary(raw: bytes, level: int | None = None):
    """The dictionary, digested once for compression at a level if one is given."""
    import zstandard as z

    d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_AUTO)
    if level is not None:
        d.precompute_compress(level=level)
    return d


class Shard:
    """Reads one shard file; document(i) is its i-th document, find(id) the first with that id."""

    def __init__(self, store: Store, name: str, dictionary: bytes):
        import zstandard as z

        self._store, self._name = store, name
        size = store.size(name)
        head, foot = store.read(name, 0, HEAD), store.read(name, size - 16, 16)
        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} isn't a shard of this dictionary")
        self._end, rows = struct.unpack("<qq", foot)
        self.index = np.frombuffer(store.read(name, self._end, 40 * rows), "<i8").reshape(rows, 5)
        self._unzip = z.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def __len__(self) -> int:
        return len(self.index)

    def _stop(self, i: int) -> int:
        return int(self.index[i + 1, 2]) if i + 1 < len(self.index) else self._end

    def document(self, i: int) -> np.ndarray:
        start = int(self.index[i, 2])
        return unpack(self._unzip(self._store.read(self._name, start, self._stop(i) - start)))

    def find(self, key: int) -> np.ndarray | None:
        at = np.flatnonzero((self.index[:, 0] == key) & (self.index[:, 1] == 0))
        return self.document(int(at[0])) if len(at) else None

    def __iter__(self) -> Iterator[np.ndarray]:
        """All documents, reading the file by blocks."""
        i = 0
        while i < len(self):
            start, j = int(self.index[i, 2]), i + 1
            while j < len(self) and self._stop(j) - start < 8 << 20:
                j += 1
            block = self._store.read(self._name, start, self._stop(j - 1) - start)
            for k in range(i, j):
                yield unpack(self._unzip(block[int(self.index[k, 2]) - start : self._stop(k) - start]))
            i = j


class Ranges:
    """The shards by id and, for ids of more rows than a shard should have, by the hash of the text.

    cuts are the greatest ids of all ranges but the last. hot gives the rows of each such id (None: null ids) and, of
    its hashes that have more than `share` rows by themselves, the rows of each; rows of one id and text are alike, so
    they may go to several shards in any order."""

    def __init__(self, cuts: list[int], hot: dict[int | None, tuple[int, dict[int, int]]], share: int):
        self.cuts, self.hot, self.count = np.array(cuts, np.int64), {}, 0
        first = []
        for key in (None, *cuts, "rest"):
            if key is not None:
                first.append(self.count)
                self.count += 1
            if key in hot:
                self._split(key, *hot[key], share)
        self.first = np.array(first, np.int32)

    def _split(self, key: int | None, rows: int, heavy: dict[int, int], share: int) -> None:
        parts = -(-rows // share)
        ends = {i * 2**64 // parts - 2**63 for i in range(1, parts)}.union(*({t - 1, t} for t in heavy))
        ends = sorted(e for e in ends if e >= -(2**63))
        widths = np.array([-(-heavy.get(e, 1) // share) for e in ends] + [1], np.int64)
        self.hot[key] = (self.count, np.array(ends, np.int64), widths.cumsum() - widths, widths)
        self.count += int(widths.sum())

    def place(self, ids: pa.Array, ties: np.ndarray, turn: int) -> np.ndarray:
        """The shard of each row; turn says where the rows of one id and text go on."""
        null, known = np.asarray(ids.is_null()), ids.fill_null(-(2**63)).to_numpy()
        out = self.first[np.searchsorted(self.cuts, known, side="left")]
        for key in {None, *known[~null].tolist()} & self.hot.keys():
            base, ends, starts, widths = self.hot[key]
            at = np.flatnonzero(null if key is None else ~null & (known == key))
            slot = np.searchsorted(ends, ties[at], side="left")
            out[at] = base + starts[slot] + (turn + np.arange(len(at))) % widths[slot]
        return out


def _compress(vocabulary: str, end: int, dictionary: bytes, ranges: Ranges):
    """Rows -> frames with their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        common.only("word_bpe", word_bpe.word_coder.cache_clear)
        zip_ = z.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary, LEVEL)).compress
        turn = TaskContext.get().partitionId() * 1_000_003
        for batch in batches:
            for x in range(0, batch.num_rows, 1000):
                rows = batch.slice(x, 1000)
                ids = [i for _, i in word_bpe.encoded(rows.column("text").to_pylist(), vocabulary, end)]
                bucket = ranges.place(rows.column("doc_id"), rows.column("tie").to_numpy(), turn)
                turn += len(rows)
                cols = [pa.array(bucket), rows.column("doc_id"), rows.column("tie"), pa.array([len(i) for i in ids], pa.int64()), pa.array([zip_(pack(i)) for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "doc_id", "tie", "n", "frame"])

    return run


def _write(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, digest, done = Store(folder), hashlib.sha256(dictionary).digest(), []

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "frame")), strict=True)

        stream, ahead = rows(), []
        ahead.append(next(stream, None))
        while ahead[0] is not None:
            bucket, index, total = ahead[0][0], [], [0]

            def chunks(bucket=bucket, index=index, total=total):
                at = HEAD
                yield MAGIC + digest
                while ahead[0] is not None and ahead[0][0] == bucket:
                    _, i, n, frame = ahead[0]
                    index.append((i or 0, i is None, at, total[0], n))
                    total[0] += n
                    at += len(frame)
                    yield frame
                    ahead[0] = next(stream, None)
                yield np.array(index, "<i8").tobytes()
                yield struct.pack("<qq", at, len(index))

            name = f"shard-{bucket:08d}"
            store.write(name, chunks())
            done.append((bucket, name, len(index), total[0]))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["bucket", "name", "rows", "tokens"])

    return run


def _hot(docs: DataFrame, cuts: list[int], nulls: int, share: int) -> dict[int | None, tuple[int, dict[int, int]]]:
    """What Ranges wants of the ids that take several of the cuts, and of null ids if they fill a shard; each such id,
    and each such hash, has more than `share` rows, so there are no more of them than shards."""
    hot = [c for c, n in Counter(cuts).items() if n > 1]
    if not hot and nulls <= share:
        return {}
    keys = [(c,) for c in [*hot, *([None] if nulls > share else [])]]
    some = docs.sparkSession.createDataFrame(keys, "hot long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie")).join(F.broadcast(some), F.col("doc_id").eqNullSafe(F.col("hot")), "left_semi")
    pairs = common.stage(rows.groupBy("doc_id", "tie").agg(F.count("*").alias("n")), "tokens-pairs")
    out: dict[int | None, tuple[int, dict[int, int]]] = {r["doc_id"]: (r["n"], {}) for r in pairs.groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect()}
    for r in pairs.where(F.col("n") > share).collect():
        out[r["doc_id"]][1][r["tie"]] = r["n"]
    common.unstage(pairs)
    return out


def write_shards(docs: DataFrame, vocabulary: str, end: int, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all rows of docs into shards of folder, in ascending id order (null ids first, then by a hash of the
    text); returns the manifest (bucket, name, rows, tokens, start), one row for each shard file.

    Ids are cut into ranges by approximate quantiles of the ids alone, and an id that takes several of them into ranges
    of the hash; rows are encoded and compressed where they are read, and only frames are shuffled. An empty table gives a dictionary and no shard."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    short = F.octet_length("text") <= FIT_BYTES
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if(short).alias("n"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    buckets = common.parts_for(spark, total["b"], shard_bytes)
    # a bounded sample to fit the dictionary on: what results say doesn't depend on it
    every = max(1, total["n"] // FIT_ROWS)
    sample = docs.where(short & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).select("text").limit(FIT_ROWS).collect()
    dictionary = train([pack(i) for _, i in word_bpe.encoded([r["text"] for r in sample], vocabulary, end)])
    Store(folder).write("dictionary", iter([dictionary]))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 4 * buckets)).first()[0] or [] if buckets > 1 else []
    share = max(1, -(-total["rows"] // buckets))
    ranges = Ranges(sorted(set(cuts)), _hot(docs, cuts, total["nulls"], share), share)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    frames = rows.mapInArrow(_compress(vocabulary, end, dictionary, ranges), "bucket int, doc_id long, tie long, n long, frame binary")
    dealt = frames.repartitionById(ranges.count, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "tie")
    manifest = sorted(dealt.mapInArrow(_write(folder, dictionary), "bucket int, name string, rows long, tokens long").collect())
    start, out = 0, []
    for m in manifest:
        out.append((m["bucket"], m["name"], m["rows"], m["tokens"], start))
        start += m["tokens"]
    return spark.createDataFrame(out, "bucket int, name string, rows long, tokens long, start long")


def read_shards(manifest: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, and ids if wanted; reads the files."""
    count = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        dictionary = store.read("dictionary")
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard, crc, kept = Shard(store, name, dictionary), [], []
                lo = 0
                for i, doc in enumerate(shard):
                    crc.append(zlib.crc32(doc.tobytes()))
                    if len(doc) != shard.index[i, 4]:
                        raise ValueError(f"{name}: document {i} isn't as long as its index says")
                    if ids:
                        kept.append(doc.astype(np.int64))
                    if len(crc) == 5000 or i + 1 == len(shard):
                        own = shard.index[lo : i + 1]
                        cols = [pa.array(own[:, 0], mask=own[:, 1] == 1), pa.array(own[:, 3] + start), pa.array(own[:, 4]), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.list_(pa.int64()))] if ids else cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])
                        lo, crc, kept = i + 1, [], []

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return manifest.repartition(count).select("name", "start").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """Write docs as shards in the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32). Null texts
    count as empty and have the end id only; null ids stand first; equal ids stand together, by the hash of their texts;
    texts are encoded whole; an empty table gives no rows, other columns are ignored."""
    folder = common.stage_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, vocabulary, end, folder), folder)
