"""Alignment of two tokenizers over the bytes of each text, and how often their tokens meet in the corpus.

A is a byte-level BPE file of the tokenizers library and reads a space and the text; B is a SentencePiece model, which
puts that space in front itself. A dangling-suffix transducer reads both token rows: its state is the side that leads
and the bytes of it that the other side hasn't matched. The side behind gives the next token; the step to the next
state is kept by (state, token). An empty residue closes a group. Each step is one link, a pair of tokens whose bytes
overlap.

Both rows break where a space stands between something that isn't a space and something that isn't white space, so a
text is aligned in chunks, each from the empty residue to the empty residue, and frequent chunks are aligned once.
`Aligner` checks that the files are of that kind and takes whole texts as chunks if they aren't.

Texts that are null or empty, or whose tokens' bytes aren't those of the space and the text, have no tokens: zeros
and no groups. Rows with null or repeated ids are documents like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.word_bpe import visible_bytes

#: Chunks that a worker keeps (a full cache takes no more) and their greatest length; pairs whose counts are sent to
#: all tasks, the most frequent ones; counts of any others are joined.
CACHE, CACHED_LENGTH, HELD_PAIRS = 600_000, 48, 1_000_000

_CUT = re.compile(r"(?<=[^ ]) (?=\S)").split
_ODD_SPACE = re.compile(r" (?:\s|$)").search


class Transducer:
    """Reads the bytes of two token rows side by side; steps are kept by state and token."""

    #: The state without a residue; others are numbered as they come up.
    EMPTY = 0

    def __init__(self, a: list[bytes], b: list[bytes], most: int = 2_000_000):
        self.tokens, self._left = (a, b), most
        self._states: list[tuple[int, bytes]] = [(1, b"")]  # (side that leads, its unmatched bytes); A begins
        self._numbers: dict[tuple[int, bytes], int] = {(1, b""): 0}
        self._steps: list[dict[int, int]] = [{}]
        self._behind = [0]  # the side that gives the next token, for each state

    def step(self, state: int, token: int) -> int:
        """The state after the side behind has given a token, -1 if the bytes differ. From EMPTY, A gives one."""
        known = self._steps[state].get(token)
        if known is None:
            lead, rest = self._states[state]
            data = self.tokens[1 - lead][token]
            if data.startswith(rest):
                new = (1 - lead, data[len(rest) :])
            elif rest.startswith(data):
                new = (lead, rest[len(data) :])
            else:
                new = None
            if new is None:
                known = -1
            elif not new[1]:
                known = self.EMPTY
            else:
                known = self._numbers.setdefault(new, len(self._states))
                if known == len(self._states):
                    self._states.append(new)
                    self._steps.append({})
                    self._behind.append(1 - new[0])
            if self._left > 0:
                self._steps[state][token] = known
                self._left -= 1
        return known

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """(ends of the groups in both rows, links) of two rows, None if their bytes differ."""
        ends, links, i, j, na, nb = [], [], 0, 0, len(a), len(b)
        steps, behind, step = self._steps, self._behind, self.step
        while i < na:
            x = a[i]
            i += 1
            state = steps[0].get(x)
            if state is None:
                state = step(0, x)
            if not state:  # a token without bytes
                return None
            while state:
                if behind[state]:
                    if j == nb:
                        return None
                    token = y = b[j]
                    j += 1
                else:
                    if i == na:
                        return None
                    token = x = a[i]
                    i += 1
                links.append((x, y))
                new = steps[state].get(token)
                state = step(state, token) if new is None else new
                if state < 0:
                    return None
            ends.append((i, j))
        return (ends, links) if j == nb else None

    @staticmethod
    def spell(a: list[int], b: list[int], ends: list[tuple[int, int]]) -> str:
        """The groups as text: ids of A and of B, with , between ids, | between sides and ; between groups."""
        out, p, q = [], 0, 0
        for i, j in ends:
            if i - p == 1 == j - q:
                out.append(f"{a[p]}|{b[q]}")
            else:
                out.append(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
            p, q = i, j
        return ";".join(out)


class Aligner:
    """Encodes texts with both tokenizers and aligns them, chunk by chunk."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self._a.encode_special_tokens = True
        units = {c: b for b, c in visible_bytes().items()}
        a_bytes = [b""] * self._a.get_vocab_size()
        for token, i in self._a.get_vocab().items():
            a_bytes[i] = bytes(units[c] for c in token) if set(token) <= set(units) else token.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.wide = len(b_bytes)
        self.code = np.dtype("<u4" if len(a_bytes) * len(b_bytes) < 1 << 32 else "<u8")
        self.transducer = Transducer(a_bytes, b_bytes)
        split = json.loads(self._a.to_str())
        self._apart = split["normalizer"] is None and (split["pre_tokenizer"] or {}).get("type") == "ByteLevel" and split["pre_tokenizer"]["use_regex"] and not any("▁" in p.lstrip("▁") for p in pieces)
        # a bare space is the first token that B gives any text that is encoded; two spaces show that none is dropped
        self._apart = self._apart and self._b.decode(self._b.encode("  x")) == "  x"
        self._cache: dict[str, tuple | None] = {}

    def chunks(self, text: str) -> list[str]:
        """A text without the space in front of it, cut at spaces; each chunk stands behind one."""
        if not self._apart:
            return [text]
        return _CUT(" " + text, 0) if text[:1].isspace() or _ODD_SPACE(text) else text.split(" ")

    def _new(self, chunks: list[str]) -> dict[str, tuple | None]:
        out: dict[str, tuple | None] = {}
        rows = self._a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)
        align, spell, held, wide = self.transducer.align, self.transducer.spell, self.transducer.tokens[0], self.wide
        for chunk, row, b in zip(chunks, rows, self._b.encode(chunks, num_threads=1), strict=True):
            a = row.ids
            got = align(a, b)
            if got is None or b"".join([held[i] for i in a]) != (" " + chunk).encode():
                out[chunk] = None
                continue
            ends, links = got
            out[chunk] = (np.array([x * wide + y for x, y in links], self.code).tobytes(), spell(a, b, ends), len(a), len(b), len(ends))
        return out

    def align_all(self, texts: list[str | None]) -> list[tuple[bytes, str, int, int, int] | None]:
        """(codes of the links in order, groups as text, tokens of A, of B, groups) of each text, None where it has no
        tokens. A link's code is A's id times the size of B's vocabulary and B's id."""
        split = []
        for t in texts:
            cut = self.chunks(t) if t else []
            if cut and self._apart and cut[0][:1] == " " and (t[:1].isspace() or _ODD_SPACE(t)):
                cut[0] = cut[0][1:]  # the first one has its space yet
            split.append(cut)
        known = self._cache
        new = self._new(list({c for cut in split for c in cut}.difference(known)))
        if len(known) + len(new) <= CACHE:
            known.update((c, x) for c, x in new.items() if len(c) <= CACHED_LENGTH)
            new = {c: x for c, x in new.items() if len(c) > CACHED_LENGTH}
        get = known.__getitem__ if not new else lambda c: known[c] if c in known else new[c]
        out = []
        for cut in split:
            got = list(map(get, cut))
            if not got or None in got:
                out.append(None)
                continue
            codes, said, a, b, groups = zip(*got, strict=True)
            out.append((b"".join(codes), ";".join(said), sum(a), sum(b), sum(groups)))
        return out


_held: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """A worker's aligner of two files."""
    common.only("token_alignment", _held.clear)
    if (a_file, b_file) not in _held:
        _held[a_file, b_file] = Aligner(a_file, b_file)
    return _held[a_file, b_file]


_ROWS = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"


def _aligned(docs: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(a_file, b_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for x in range(0, batch.num_rows, 200):
                rows = batch.slice(x, 200)
                got = own.align_all(rows.column(1).to_pylist())
                n = [[0 if y is None else y[k] for y in got] for k in (2, 3, 4)]
                said = ["" if y is None else hashlib.sha256(y[1].encode()).hexdigest() if digest else y[1] for y in got]
                links = [b"" if y is None else y[0] for y in got]
                numbers = np.arange(number, number + len(got))
                number += len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), rows.column(0), *(pa.array(k, pa.int64()) for k in n), pa.array([len(y) // own.code.itemsize for y in links], pa.int64()), pa.array(said), pa.array(links, pa.binary())],
                    ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _ROWS)


def _pair_counts(rows: DataFrame, code: np.dtype) -> DataFrame:
    """(code, docs): in how many rows each link stands; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = np.zeros(0, code), np.zeros(0, np.int64), []

        def merged():
            own, n = np.unique(np.concatenate(held), return_counts=True) if held else (codes[:0], counts[:0])
            both, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        size = 0
        for batch in batches:
            for links in batch.column(0):
                own = np.unique(np.frombuffer(links.as_buffer() or b"", code))
                held.append(own)
                size += len(own)
            if size > 1_000_000:
                codes, counts = merged()
                held, size = [], 0
                if len(codes) > 4_000_000:  # what a task holds is bounded; the rest is added up behind the exchange
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["code", "docs"])
                    codes, counts = codes[:0], counts[:0]
        codes, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["code", "docs"])

    return rows.select("links").mapInArrow(run, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))


def pair_counts(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, docs, best) of all id pairs that are linked anywhere: the documents that hold the pair, and whether no
    other pair of its A id is in more. docs of texts without tokens, and an empty table, have none."""
    spark = docs.sparkSession
    common.ship(spark)
    own = Aligner(a_file, b_file)
    rows = common.stage(_aligned(docs, a_file, b_file, id_col, text_col, True), "alignment")
    return _with_best(_pair_counts(rows, own.code), own.wide).select(F.expr(f"code div {own.wide}").alias("a"), F.expr(f"code % {own.wide}").alias("b"), "docs", "best")


def _with_best(counts: DataFrame, wide: int) -> DataFrame:
    keyed = counts.withColumn("a", F.expr(f"code div {wide}"))
    most = keyed.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as A has ids: a bounded table
    return keyed.join(F.broadcast(most), "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_documents(
    docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True, held_pairs: int = HELD_PAIRS
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; with digest=False groups, the
    groups as text (`a1,a2|b1;a3|b2,b3`), in the last one's place. n_best: links whose pair is in as many documents as
    any of its A id; count_sum: the sum of its links' counts.

    Links are staged once, as 4-byte codes. The counts of the held_pairs most frequent pairs, a bounded table, are sent
    to all tasks; counts of rarer ones are joined, none of which can be frequent."""
    spark = docs.sparkSession
    common.ship(spark)
    own = Aligner(a_file, b_file)
    code, wide = own.code, own.wide
    rows = common.stage(_aligned(docs, a_file, b_file, id_col, text_col, digest), "alignment")
    counts = common.stage(_with_best(_pair_counts(rows, code), wide), "alignment-counts")
    # how many pairs have counts of so many binary digits: a row for each number of digits
    digits = F.length(F.bin("docs"))
    left, level, total = held_pairs, 64, 0
    by_digits = {r["d"]: r["n"] for r in counts.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect()}
    for d in sorted(by_digits, reverse=True):
        if by_digits[d] > left:
            break
        left, level, total = left - by_digits[d], d, total + by_digits[d]
    held = counts.where(digits >= level).orderBy("code").toArrow()
    table = spark.sparkContext.broadcast((held["code"].to_numpy().astype(code), held["docs"].to_numpy(), held["best"].to_numpy(zero_copy_only=False)))

    def look(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and which links are in it."""
        known = table.value[0]
        if not len(known):
            return np.zeros(len(links), np.int64), np.zeros(len(links), bool)
        at = np.minimum(np.searchsorted(known, links), len(known) - 1)
        return at, known[at] == links

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs_of, best_of = table.value
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                part = batch.slice(x, 500)
                data = [y.as_buffer() or b"" for y in part.column("links")]
                ends = np.cumsum([0, *(len(y) // code.itemsize for y in data)])
                distinct, back = np.unique(np.frombuffer(b"".join(data), code), return_inverse=True)
                at, ok = look(distinct)
                n = np.where(ok, docs_of[at] if len(docs_of) else 0, 0)[back]
                best = np.where(ok, best_of[at] if len(best_of) else False, False)[back]
                sums = [np.diff(np.r_[0, np.cumsum(y, dtype=np.int64)][ends]) for y in (best, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _COLUMNS), *(pa.array(y) for y in sums)], [*_COLUMNS, "n_best", "count_sum"])

    told = rows.mapInArrow(tell, ", ".join(f"{c} {'string' if c == 'groups' else 'long'}" for c in _COLUMNS) + ", n_best long, count_sum long")
    if total < sum(by_digits.values()):

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, links in zip(batch.column("row").to_pylist(), batch.column("links"), strict=True):
                    distinct, n = np.unique(np.frombuffer(links.as_buffer() or b"", code), return_counts=True)
                    rare = ~look(distinct)[1]
                    if rare.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(rare.sum(), row)), pa.array(distinct[rare].astype(np.int64)), pa.array(n[rare].astype(np.int64))], ["row", "code", "n"])

        rest = rows.select("row", "links").mapInArrow(others, "row long, code long, n long").join(counts, "code")
        rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("docs")).alias("more"))
        told = told.join(rest, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return told.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256" if digest else "groups"))


_COLUMNS = ("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
