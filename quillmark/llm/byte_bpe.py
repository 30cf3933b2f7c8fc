"""Byte-level BPE encoding and decoding of rank files, by prefix dynamic programming.

A pattern splits the text; each match is encoded on its bytes by `PrefixBPE`, which stores the unique valid last
token of each byte prefix (`TextEncoding` keeps it, for appends and edits). Null counts as the empty text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.bpe import CACHE, CACHED_LENGTH, PrefixBPE, PrefixEncoding


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.bpe, self._pattern = ranks, PrefixBPE(ranks), regex.compile(pattern)
        self._find = self._pattern.findall
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self._bytes[i] = t
        self._cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self._find(text)

    def split(self, text: str, start: int = 0) -> Iterator:
        """Matches of the pieces from a place on where one begins."""
        return self._pattern.finditer(text, start)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces, from tables that share their prefixes."""
        ranks, walk = self.ranks, self.bpe.walk
        made = {w: array("I", [ranks[t] for t in walk(last)]).tobytes() for w, _, last in self.bpe.tables(p.encode("utf-8", "surrogatepass") for p in pieces)}
        return {p: made[p.encode("utf-8", "surrogatepass")] for p in pieces}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers."""
        pieces = [self._find(t) for t in texts]
        known = self._cache
        new = self._learn(set(chain.from_iterable(pieces)).difference(known))
        if len(known) + len(new) <= CACHE:
            known.update((p, i) for p, i in new.items() if len(p) <= CACHED_LENGTH)
            new = {p: i for p, i in new.items() if len(p) > CACHED_LENGTH}
        get = known.__getitem__ if not new else lambda p: known[p] if p in known else new[p]
        return [np.frombuffer(b"".join(map(get, p)), "<u4") for p in pieces]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.asarray(ids).tolist()))


class TextEncoding:
    """A text's encoding that grows and is edited. Pieces before the edit and behind it are kept as they are; between, the
    text is split and encoded again, from two pieces before the edit (the pattern looks ahead, never back) until a piece
    begins where one began before."""

    def __init__(self, coder: ByteBPE, text: str = ""):
        self.coder, self.text = coder, ""
        self._pieces: list[PrefixEncoding] = []
        self._starts: list[int] = []
        #: Pieces split anew by the last change, for those who want to know what it cost.
        self.renewed = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> TextEncoding:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> TextEncoding:
        """Put new in place of text[start:end]."""
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first = max(0, bisect_left(self._starts, start) - 2)
        at = self._starts[first] if first < len(self._starts) else 0
        old, starts, pieces = first, [], []
        rest = len(self._starts)
        for m in self.coder.split(self.text, at):
            # the old piece that begins here, behind the edit
            if m.start() >= start + len(new):
                old = bisect_left(self._starts, max(end, m.start() - shift), old)
                if old < len(self._starts) and self._starts[old] == m.start() - shift:
                    rest = old
                    break
            starts.append(m.start())
            pieces.append(self._encoded(m[0].encode("utf-8", "surrogatepass"), first + len(pieces)))
        self.renewed = len(pieces)
        self._starts[first:] = starts + [x + shift for x in self._starts[rest:]]
        self._pieces[first:] = pieces + self._pieces[rest:]
        return self

    def _encoded(self, data: bytes, place: int) -> PrefixEncoding:
        """A piece from the one that stood in its place, which it begins and ends like as far as it does."""
        if place >= len(self._pieces):
            return PrefixEncoding(self.coder.bpe, data)
        before = self._pieces[place]
        n = min(len(data), len(before.data))
        lo = next((i for i in range(n) if data[i] != before.data[i]), n)
        hi = next((i for i in range(n - lo) if data[-1 - i] != before.data[-1 - i]), n - lo)
        if lo == len(data) == len(before.data):
            return before
        out = PrefixEncoding(self.coder.bpe)
        out.data, out.last = before.data, before.last
        return out.replace(lo, len(before.data) - hi, data[lo : len(data) - hi])

    def ids(self) -> list[int]:
        return [self.coder.ranks[t] for t in chain.from_iterable(x.tokens() for x in self._pieces)]


@cache
def byte_coder(rank_file: str, pattern: str) -> ByteBPE:
    with open(rank_file, "rb") as f:
        return ByteBPE({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}, pattern)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip) of every row, and ids (array) if wanted. Encodes,
    then decodes the ids; round_trip tells whether the bytes came back. Null texts
    count as empty; repeated and null ids are kept; texts of any length are taken whole, in time linear in their pieces;
    an empty table gives no rows; other columns are ignored."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("byte_bpe", byte_coder.cache_clear)
        coder = byte_coder(rank_file, pattern)
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                rows = batch.slice(x, 500)
                n, sha, back, same, kept = [], [], [], [], []
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for text, got in zip(texts, coder.encode_all(texts), strict=True):
                    data = coder.decode(got)
                    n.append(len(got))
                    sha.append(hashlib.sha256(got.tobytes()).hexdigest())
                    back.append(hashlib.sha256(data).hexdigest())
                    same.append(data == text.encode("utf-8", "surrogatepass"))
                    if ids:
                        kept.append(got.astype(np.int64))
                cols, names = [rows.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.array(same)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
                if ids:
                    cols.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_null(c.type) else c for c in cols], names)

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<long>" * ids
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
