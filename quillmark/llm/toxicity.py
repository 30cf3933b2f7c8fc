"""Toxicity scores from a lexicon, with Levenshtein automata for misspelled terms and context windows for quotation.

The lexicon is learned: words that are far more frequent in toxic training documents than in others, and stems, the
beginnings that toxic words of different endings share. Words of the lexicon form a trie; any other word of a text runs
through the trie together with the automaton of all strings one edit away, so misspelled terms are caught (a cheap
necessary test comes first). An ordinary word is no misspelling, however near it is: one that clean training texts hold
too, or that a vocabulary file has as a whole word (but not a term and one letter more). A word that isn't misspelled may still have a stem.
Each hit is weighed in its window of words: between quotation marks it counts as quotation, else as abuse, and hits
that stand together count as density; stems and misspellings are figures of their own too. A logistic model over these
figures gives the score.

A stem has STEM_WORDS different toxic words behind it, and they branch there: a beginning whose words nearly all go on
with the same letter says no more than that letter's, so no single word makes its own beginnings stems.

Fit: about FIT_ROWS labelled rows, a share of them by the hash of their id; only the ids and labels of that many are
held, term counts are aggregated on the executors, and the driver gets the terms that LEAST_DOCS toxic rows of the
sample or more have, the ordinary words next to them, and FIT_ROWS rows of a few numbers. Scoring reads whole texts of
all rows, in time linear in their words. Null text counts as empty; null and repeated ids are rows like any other;
without both kinds of label, scores are 0; an empty table gives no rows; other columns are ignored. Texts without a hit,
empty ones too, get one score: the rate of toxic texts among such texts in training.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common

#: Bound of the fit; toxic documents that a term needs, and its odds against other documents.
FIT_ROWS, LEAST_DOCS, LEAST_ODDS = 20_000, 4, 12.0
#: Lengths of stems, different toxic words that one needs, and the share of them that may go on with the same letter.
STEMS, STEM_WORDS, BRANCH = range(4, 11), 5, 0.8
#: Clean documents in which a word next to a term is taken for an ordinary one.
LEAST_CLEAN = 2
#: Words to each side of a hit; shortest word with a misspelling; score from which a document counts as toxic.
CONTEXT, LEAST_FUZZY, THRESHOLD = 8, 5, 0.3
#: Entries of a worker's word cache; a full one takes no more.
CACHE = 800_000

_EDGES = ".,;:!?…\"'`´‘’“”„«»‹›()[]{}<>*_-–—"
_MARK, _CLOSE = re.compile("[\"“”„«»‹›‘’]|(?:^|(?<=\\W))'|'(?=\\W|$)"), re.compile("[\"”“»›’]|'(?:$|(?=\\W))")


class LevenshteinTrie:
    """A trie of words, searched with the automaton of all strings at most `edits` edits from a word."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            at = self.root
            for c in w:
                at = at.setdefault(c, {})
            at[""] = w

    def search(self, word: str, edits: int = 1) -> list[str]:
        """The trie's words within `edits` edits. A state of the automaton is, for each number of edits, the set of
        places in word that can be reached, as bits; it is run along the trie's branches while it is alive."""
        n = len(word)
        where: dict[str, int] = {}
        for i, c in enumerate(word):
            where[c] = where.get(c, 0) | 1 << i
        full = (1 << (n + 1)) - 1

        def close(state: list[int]) -> list[int]:
            for e in range(1, edits + 1):  # a letter of word left out
                state[e] |= (state[e - 1] << 1) & full
            return state

        found, stack = [], [(self.root, close([1] + [0] * edits))]
        while stack:
            node, state = stack.pop()
            if "" in node and any(s >> n & 1 for s in state):
                found.append(node[""])
            for c, child in node.items():
                if not c:
                    continue
                hit = where.get(c, 0)
                new = [((s & hit) << 1) & full for s in state]
                for e in range(1, edits + 1):  # another letter in its place, or a letter put in
                    new[e] |= ((state[e - 1] << 1) | state[e - 1]) & full
                if any(new):
                    stack.append((child, close(new)))
        return found


def bare(token: str) -> str:
    return token.strip(_EDGES).lower()


class Lexicon:
    """Terms: {term: weight} of whole words and of stems; ordinary: words that are no misspellings."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], ordinary: Iterable[str] = ()):
        self.words, self.stems, self.ordinary = words, stems, frozenset(ordinary)
        self._lengths = sorted({len(t) for t in stems}, reverse=True)
        fuzzy = [w for w in words if len(w) >= LEAST_FUZZY]
        self.trie = LevenshteinTrie(fuzzy)
        # one edit apart means that the words, or what is left of them without one letter, are equal
        self._near = {w[:i] + w[i + 1 :] for w in fuzzy for i in range(len(w))} | set(fuzzy)
        self._cache: dict[str, tuple | None] = {}

    def misspelled(self, w: str) -> list[str]:
        """Words of the lexicon one edit from w."""
        near = self._near
        if w not in near and not any(w[:i] + w[i + 1 :] in near for i in range(len(w))):
            return []
        return self.trie.search(w, 1)

    def look(self, token: str) -> tuple | None:
        """(term, weight, kind) of a token: kind 0 is the word itself, 1 a stem, 2 a misspelling."""
        w = bare(token)
        if w in self.words:
            return w, self.words[w], 0
        near = self.misspelled(w) if len(w) >= LEAST_FUZZY - 1 and w not in self.ordinary else None
        if near:
            best = max(near, key=lambda t: (self.words[t], t))
            return best, self.words[best], 2
        for n in self._lengths:
            if len(w) >= n and w[:n] in self.stems:
                return w[:n], self.stems[w[:n]], 1
        return None

    def hits(self, texts: list[list[str]]) -> list[list[tuple[int, tuple]]]:
        """(place, what look() says) of the hits in each text's tokens."""
        known = self._cache
        new = {t: self.look(t) for t in set(chain.from_iterable(texts)).difference(known)}
        if len(known) + len(new) <= CACHE:
            known.update(new)
            new = {}
        get = known.__getitem__ if not new else lambda t: known[t] if t in known else new[t]
        return [[(i, x) for i, x in enumerate(map(get, t)) if x is not None] for t in texts]


def quoted(tokens: list[str], at: int) -> bool:
    """Whether a quotation is open at a place and closes behind it, both within its window. Straight marks open and
    close by turns; a straight apostrophe counts only at a word's edge."""
    before = " ".join([*tokens[max(0, at - CONTEXT) : at], tokens[at][: len(tokens[at]) - len(tokens[at].lstrip(_EDGES))]])
    behind = " ".join(tokens[at : at + CONTEXT + 1])
    is_open = False
    for mark in _MARK.findall(before):
        is_open = mark in "„«‹‘" or mark in "\"'“" and not is_open
    return is_open and bool(_CLOSE.search(behind, 1))


N_FIGURES = 8


def figures(tokens: list[str], hits: list[tuple[int, tuple]]) -> list[float]:
    """What the model sees of a text; nothing but zeros where it has no hit, however long it is."""
    if not hits:
        return [0.0] * N_FIGURES
    plain, cited = [], []
    for at, hit in hits:
        (cited if quoted(tokens, at) else plain).append((at, hit))
    weight = lambda xs: sum(x[1][1] for x in xs)
    places = [at for at, _ in plain]
    density = max((sum(abs(p - q) <= CONTEXT for q in places[max(0, i - CONTEXT) : i + CONTEXT + 1]) for i, p in enumerate(places)), default=0)
    return [
        max((h[1] for _, h in plain), default=0.0), math.log1p(weight(plain)), math.log1p(weight(cited)), math.log1p(len({h[0] for _, h in plain})), math.log1p(density),
        *(math.log1p(weight([x for x in plain if x[1][2] == kind])) for kind in (1, 2)), weight(plain) / (len(tokens) + 20),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept first) of a ridge logistic regression, by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    keep = np.r_[1e-6, np.full(x.shape[1], ridge)] * len(x) ** 0.5
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Model:
    """A lexicon, a logistic model of texts with hits, and the score of texts without any: their rate in training."""

    def __init__(self, lexicon: Lexicon, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, none: float = 0.0):
        self.lexicon, self.mean, self.scale, self.weights, self.none = lexicon, mean, scale, weights, none

    def figures(self, texts: list) -> np.ndarray:
        tokens = [(t or "").split() for t in texts]
        return np.array([figures(t, h) for t, h in zip(tokens, self.lexicon.hits(tokens), strict=True)]).reshape(-1, N_FIGURES)

    def score(self, texts: list) -> np.ndarray:
        x = self.figures(texts)
        z = (x - self.mean) / self.scale
        return np.where(x.any(1), 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30))), self.none)


def is_held_out(id_col) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.only("toxicity")
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        terms = list(set(counts[0]) | set(counts[1]))
        for x in range(0, len(terms), 50_000):
            y = terms[x : x + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(y), *(pa.array([c[t] for t in y], pa.int64()) for c in counts)], ["term", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({w for w in map(bare, set((text or "").split())) if len(w) > 2})
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield from flush()
            for c in counts:
                c.clear()
    yield from flush()


def _weight(clean: int, toxic: int, n_clean: int, n_toxic: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1)))


def stems_of(words: DataFrame, odds) -> DataFrame:
    """(stem, clean, toxic) of the words (term, clean, toxic): beginnings that different toxic words share."""
    begin = words.select(F.explode(F.expr(f"transform(filter(sequence({STEMS[0]}, {STEMS[-1] + 1}), n -> n <= length(term)), n -> left(term, n))")).alias("stem"), "clean", "toxic")
    counted = begin.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count_if(F.col("toxic") > 0).alias("words"))
    longest = counted.groupBy(F.expr("left(stem, length(stem) - 1)").alias("stem")).agg(F.max("words").alias("most"))
    good = counted.where((F.length("stem") <= STEMS[-1]) & (F.col("words") >= STEM_WORDS) & (F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_ODDS))
    return good.join(longest, "stem", "left").where(F.coalesce("most", F.lit(0)) <= BRANCH * F.col("words")).select("stem", "clean", "toxic")


def whole_words(vocabulary: str) -> set[str]:
    """The whole words of a tokenizers file with word ends or with marks for spaces."""
    with open(vocabulary, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    return {w for t in tokens for w in (t.removesuffix("</w>") if t.endswith("</w>") else t[1:] if t[:1] in "Ġ▁" else "",) if w.isalpha()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", vocabulary: str | None = None) -> Model | None:
    """A model from the rows of docs that labels has a label for, held-out rows left aside; None without both kinds.
    vocabulary: a tokenizers file, read on the driver, whose whole words aren't misspellings of others."""
    spark = docs.sparkSession
    common.ship(spark)
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    # a share of the labelled ids by their hash, about FIT_ROWS: a task's rows don't wait for those of others
    share = min(1.0, FIT_ROWS / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # about FIT_ROWS ids and labels, a bounded number
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    rows = common.stage(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "toxic-fit")
    of = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(of) < 2:
        return None
    counted = common.stage(rows.mapInArrow(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-terms")
    odds = (F.col("toxic") + 0.5) / (of[1] + 1) / ((F.col("clean") + 0.5) / (of[0] + 1))
    words, stems = (
        {r[0]: _weight(r["clean"], r["toxic"], of[0], of[1]) for r in x.collect()} for x in (counted.where((F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_ODDS)), stems_of(counted, odds))
    )
    first = Lexicon(words, stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if w not in words and first.misspelled(w)], pa.string())], ["term"])

    # words of clean texts one edit from a term, no more than the sample has
    ordinary = {r["term"] for r in counted.where((F.col("clean") >= LEAST_CLEAN) & (odds < LEAST_ODDS)).select("term").mapInArrow(near, "term string").collect()}
    if vocabulary is not None:
        # a term with a letter behind it (`morons`) is a form of it, not another word
        ordinary |= {w for w in whole_words(vocabulary) if w not in words and any(not w.startswith(t) for t in first.misspelled(w))}
    lexicon = Lexicon(words, stems, ordinary)
    blank = Model(lexicon, np.zeros(N_FIGURES), np.ones(N_FIGURES), np.zeros(N_FIGURES + 1))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(blank.figures(batch.column("text").to_pylist())), pa.list_(pa.float64())), batch.column("toxic")], ["x", "y"])

    seen = rows.mapInArrow(describe, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)
    common.unstage(counted)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    without = y[~x.any(1)]
    return Model(lexicon, *fit_logistic(x[order], y[order]), (without.sum() + y.mean()) / (len(without) + 1))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(id_col, F.lit(0.0).alias("score"))

    terms, rest = (model.lexicon.words, model.lexicon.stems, model.lexicon.ordinary), (model.mean, model.scale, model.weights, model.none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("toxicity")
        own = Model(Lexicon(*terms), *rest)
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                part = batch.slice(x, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(part.column(1).to_pylist()))], [id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` long, score double")


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, vocabulary: str | None = None) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs."""
    scored = score(docs, fit(docs, labels, id_col, text_col, vocabulary=vocabulary), id_col, text_col)
    return scored.select(id_col, is_held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, vocabulary: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold; equal texts are judged alike. Null
    texts count as empty, rows with any null stay rows, an empty table gives no rows; other columns pass through."""
    model = fit(docs, labels, id_col, text_col, vocabulary=vocabulary)
    if model is None:
        return docs
    terms, rest = (model.lexicon.words, model.lexicon.stems, model.lexicon.ordinary), (model.mean, model.scale, model.weights, model.none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("toxicity")
        own = Model(Lexicon(*terms), *rest)
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                part = batch.slice(x, 500)
                yield part.filter(pa.array(own.score(part.column(part.schema.get_field_index(text_col)).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
