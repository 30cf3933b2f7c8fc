"""Exact token counts at every prefix of a text, for a SentencePiece BPE model, by prefix dynamic programming.

The model's text is its characters with U+2581 for spaces and one U+2581 in front. Pieces hold U+2581 only in front
or alone, so a chunk (spaces and the word behind them) is encoded apart from the others, and a text's counts are
sums of chunk counts. Within a chunk `PrefixBPE` stores each prefix's last token, hence each prefix's count; what a
text needs more than once is kept per word. Truncation and budget questions are answered from the counts alone.

Characters without a piece count one token for each UTF-8 byte. Null counts as the empty text, which has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.bpe import CACHE, CACHED_LENGTH, PrefixBPE

SPACE = "▁"
#: Longest run of spaces that is one piece; longer runs take one such piece more for each so many.
RUN = 16


class PrefixCounts:
    """Token counts of all prefixes of texts, by code points."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in ids}
        self._single = {t for t in ranks if len(t) == 1}
        self._bpe = PrefixBPE(ranks, {t: r for t, r in ranks.items() if len(t) > 1 and set(t) != {SPACE}})
        self._run = [0, *(len(sp.encode(" " * k)) if k else 1 for k in range(RUN))]
        self._words: dict[str, np.ndarray] = {}
        self._totals: dict[str, int] = {"": 0}

    def _spaces(self, k: int) -> int:
        """Tokens of k spaces that no word follows."""
        return self._run[(k - 1) % RUN + 1] + (k - 1) // RUN if k else 0

    def word(self, w: str) -> np.ndarray:
        """Counts of the prefixes, of length 1 and more, of one space and the word w (no spaces in it)."""
        known = self._words.get(w)
        if known is None:
            last = self._bpe.last_tokens(SPACE + w)
            known = np.zeros(len(last), np.int32)
            counts: list[int] = []
            for i, t in enumerate(last):
                own = 1 if len(t) > 1 or t in self._single else len(t.encode("utf-8", "surrogatepass"))
                counts.append(own + (counts[i - len(t)] if i >= len(t) else 0))
            known = np.array(counts, np.int32)
            if len(w) <= CACHED_LENGTH and len(self._words) < CACHE // 8:
                self._words[w] = known
        return known

    def _joins(self, w: str) -> bool:
        """Whether the space before w goes into w's first token."""
        return bool(w) and len(self._bpe.walk(self._bpe.last_tokens(SPACE + w))[0]) > 1

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Token totals of words that follow one space, new ones from tables that share their prefixes."""
        new: dict[str, int] = {}
        counts: list[int] = []
        single = self._single
        for w, n, last in self._bpe.tables(SPACE + w for w in words):
            del counts[n:]
            for i in range(n, len(last)):
                t = last[i]
                k = len(t)
                own = 1 if k > 1 or t in single else len(t.encode("utf-8", "surrogatepass"))
                counts.append(own + counts[i - k] if i >= k else own)
            new[w[1:]] = counts[-1]
        return new

    def totals(self, texts: list[str], limit: int | None = None) -> list[tuple[int, int | None]]:
        """(tokens of the whole text, code points of its longest prefix within limit if the text exceeds it)."""
        split = [t.replace(SPACE, " ").split(" ") for t in texts]
        known = self._totals
        new = self._learn(set(chain.from_iterable(split)).difference(known))
        if len(known) + len(new) <= CACHE:
            known.update((w, n) for w, n in new.items() if len(w) <= CACHED_LENGTH)
            new = {w: n for w, n in new.items() if len(w) > CACHED_LENGTH}
        get = known.__getitem__ if not new else lambda w: known[w] if w in known else new[w]
        return [self._total(t, words, get, limit) for t, words in zip(texts, split, strict=True)]

    def _total(self, text: str, words: list[str], get, limit: int | None) -> tuple[int, int | None]:
        if not text:
            return 0, None
        own = np.fromiter(map(get, words), np.int64, len(words))
        empty = np.flatnonzero(own == 0)
        if len(empty):  # runs of spaces: what they take goes to the word behind them
            i = 0
            while i < len(empty):
                j = i
                while j + 1 < len(empty) and empty[j + 1] == empty[j] + 1:
                    j += 1
                at, spaces = int(empty[j]) + 1, j - i + 1
                if at == len(words):
                    own[at - 1] = self._spaces(spaces)
                else:
                    own[at] += self._spaces(spaces) if self._joins(words[at]) else self._spaces(spaces + 1) - 1
                i = j + 1
        up = np.cumsum(own)
        total = int(up[-1])
        if limit is None or total <= limit:
            return total, None
        # counts never fall from word to word: the longest prefix ends in the first word that goes over the limit,
        # or in the spaces before it
        k = int(np.searchsorted(up, limit, side="right"))
        first = k
        while first and not words[first - 1]:
            first -= 1
        spaces = k - first
        if first == 0:
            return total, int(np.flatnonzero(self.prefixes(" " * spaces + words[k]) <= limit)[-1])
        done = sum(map(len, words[:first])) + first - 1
        counts = np.r_[0, self._spaces(1), self.prefixes(" " * spaces + words[k])[1:]]  # its space in front stands in the text
        return total, done + int(np.flatnonzero(up[first - 1] + counts <= limit)[-1])

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        return self.totals([text])[0][0]

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of all prefixes: entry i is for the first i code points, entry 0 is 0."""
        out = np.zeros(len(text) + 1, np.int64)
        if not text:
            return out
        words = text.replace(SPACE, " ").split(" ")
        at, base, spaces = 0, 0, 0  # at: code points done; the space in front is no code point of the text
        for k, w in enumerate(words):
            if k:
                at += 1
                out[at] = base + self._spaces(spaces + 1)
            if w:
                c = self.word(w)
                if spaces == 0:
                    before = np.full(len(w), base)
                else:
                    last = self._bpe.last_tokens(SPACE + w)
                    lone = self._spaces(spaces + 1) - 1
                    first = np.empty(len(last), np.int32)  # length of the first token of each prefix
                    for i, t in enumerate(last):
                        first[i] = first[i - len(t)] if i >= len(t) else len(t)
                    before = base + np.where(first[1:] > 1, self._spaces(spaces), lone)
                out[at + 1 : at + len(w) + 1] = before + c[1:]
                at += len(w)
                base, spaces = int(out[at]), 0
            else:
                spaces += 1
        return out

    def cut(self, text: str, budget: int) -> int:
        """Code points of the longest prefix that takes at most budget tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


@cache
def counter(model_file: str) -> PrefixCounts:
    return PrefixCounts(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, limit_chars) of every row, limit_chars being the code points of the
    longest prefix within the limit (null: the whole text is), read off the prefix counts; with prefixes, also
    prefix_counts, the counts of all prefixes. Null texts count as empty; repeated and null ids are kept; texts of any
    length are taken whole, in time linear in their words; an empty table gives no rows; other columns are ignored."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("token_counts", counter.cache_clear)
        c = counter(model_file)
        for batch in batches:
            for x in range(0, batch.num_rows, 1000):
                rows = batch.slice(x, 1000)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                n, cuts = zip(*c.totals(texts, limit), strict=True)
                cols = [rows.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([m > limit for m in n]), pa.array(cuts, pa.int64())]
                names = [id_col, "n_bytes", "n_tokens", "over_limit", "limit_chars"]
                if prefixes:
                    cols.append(pa.array([c.prefixes(t).tolist() for t in texts], pa.list_(pa.int64())))
                    names.append("prefix_counts")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long" + ", prefix_counts array<long>" * prefixes
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
