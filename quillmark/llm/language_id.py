"""Languages of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams of one to four characters of a text's words (letters and marks, lower case, a space on each
side), weighed (1 + log count) * idf and brought to length one. Weights are learned by follow-the-regularised-leader:
each coordinate has its own rate, an L1 penalty keeps weights of n-grams that tell little at exactly zero, an L2 penalty
shrinks the others. Each epoch runs over the parts of the sample at once and averages what they have learned. A
temperature, fitted on sample rows that took no part in that, turns the margins into probabilities.

The fit takes a bounded sample: about FIT_ROWS texts of each language by the hash of their ids, of rows that aren't
held out and have an id, a language and a text; n-grams are counted and weights learned on the executors, the driver
holds VOCABULARY n-grams and their weights. Every row is then scored on its whole text, in time linear in its words.

Null texts and texts without a letter are `und` with score 0, as is everything if no row has a language; with one
language, all other texts are of it with score 1. Texts that share no n-gram with the sample get the most frequent
languages of the intercept. Null and repeated ids are rows like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common
from quillmark.llm.toxicity import is_held_out

#: Bounds of the fit: texts of a language, n-grams, texts that an n-gram needs; longest n-gram; n-grams are known by
#: hashes of so many bits.
FIT_ROWS, VOCABULARY, LEAST_DOCS, LONGEST, BITS = 2_000, 40_000, 3, 4, 20
#: Learning rate and its damping, L1 and L2 penalties, passes over the sample, parts of it that learn side by side,
#: one of so many rows kept for the temperature.
ALPHA, BETA, L1, L2, EPOCHS, PARTS, CALIBRATION = 4.0, 1.0, 0.01, 0.02, 5, 4, 8
#: Code points of a text that are worked on at once; fewest texts of a part that learns on its own.
SLICE, PART_ROWS = 1_000_000, 1_000

UNDETERMINED = "und"

@cache
def _kinds() -> np.ndarray:
    """Of each code point: 2 for letters, 1 for marks, 0 for all others."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def has_letter(text: str) -> bool:
    return any((_kinds()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)] == 2).any() for part in _slices(text))


def _slices(text: str) -> Iterator[str]:
    """A text in parts of bounded size, cut at spaces; words longer than a part are cut."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(" ", at, at + SLICE) + 1 or at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:]


def buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of a text, one for each place: n-grams of one to LONGEST characters within a word that
    has a space on each side, without the bare space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inner = _kinds()[c] > 0
    # one space behind each word, and one in front
    keep = inner.copy()
    keep[1:] |= inner[:-1]
    c = np.concatenate([[32], np.where(inner, c, 32)[keep], [32] if len(c) and inner[-1] else []]).astype(np.uint64)
    if len(c) == 1:
        return np.zeros(0, np.int32)
    space, out = c == 32, []
    # a word that doesn't begin behind a space can only be the first one, which has its own
    h = c
    whole = ~space
    for n in range(1, LONGEST + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
            # of longer ones, no inner place is a space
            whole = np.ones(len(h), bool) if n == 2 else whole[:-1] & ~space[n - 2 : len(c) - 1]
        own = h[whole] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        out.append(((own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out)


class Features:
    """Texts to sparse vectors of length one, over the chosen buckets of n-grams."""

    def __init__(self, chosen: np.ndarray, idf: np.ndarray):
        self.idf = idf
        self._number = np.full(1 << BITS, len(chosen), np.int32)
        self._number[chosen] = np.arange(len(chosen), dtype=np.int32)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(features, their values) of a text."""
        n = np.zeros(len(self.idf) + 1, np.int64)
        for part in _slices(text):
            n += np.bincount(self._number[buckets(part)], minlength=len(n))
        at = np.flatnonzero(n[:-1])
        x = (1 + np.log(n[at])) * self.idf[at]
        return at, x / math.sqrt(x @ x) if len(x) else x


class FollowTheLeader:
    """Multinomial logistic regression whose weights follow from sums of gradients (z) and of their squares (n).
    The last row is the intercept, which no penalty touches."""

    def __init__(self, features: int, classes: int, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros((features + 1, classes)) if z is None else z
        self.n = np.zeros((features + 1, classes)) if n is None else n

    @staticmethod
    def _solve(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2), 0.0)

    def weights(self) -> np.ndarray:
        return np.vstack([self._solve(self.z[:-1], self.n[:-1], L1, L2), self._solve(self.z[-1:], self.n[-1:], 0.0, 0.0)])

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        z, n = self.z[at], self.n[at]
        w, w0 = self._solve(z, n, L1, L2), self._solve(self.z[-1], self.n[-1], 0.0, 0.0)
        m = x @ w + w0
        p = np.exp(m - m.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        more = n + g * g
        self.z[at] = z + g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more
        more = self.n[-1] + p * p
        self.z[-1] += p - (np.sqrt(more) - np.sqrt(self.n[-1])) / ALPHA * w0
        self.n[-1] = more


def temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the margins that makes the labels likeliest, by golden section over its logarithm. A label counts
    as right with all but one of the rows and two more, so that rows without an error don't drive it to zero."""
    if not len(margins):
        return 1.0
    k = margins.shape[1]
    target = np.full(margins.shape, 1 / (len(margins) + 2) / max(1, k - 1))
    target[np.arange(len(margins)), labels] = 1 - 1 / (len(margins) + 2)

    def loss(t: float) -> float:
        m = margins / math.exp(t)
        m = m - m.max(1, keepdims=True)
        return -(target * (m - np.log(np.exp(m).sum(1, keepdims=True)))).sum()

    a, b, r = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    for _ in range(40):
        if loss(c) < loss(d):
            b = d
        else:
            a = c
        c, d = b - r * (b - a), a + r * (b - a)
    return math.exp((a + b) / 2)


class Model:
    """Buckets of n-grams with their idf, weights (the intercept last) of each language, and the temperature."""

    def __init__(self, languages: list[str], chosen: np.ndarray, idf: np.ndarray, weights: np.ndarray, t: float):
        self.languages, self.chosen, self.idf, self.weights, self.t, self.key = languages, chosen, idf, weights, t, uuid.uuid4().hex

    def features(self) -> Features:
        return Features(self.chosen, self.idf)

    def margins(self, features: Features, text: str) -> np.ndarray:
        at, x = features.vector(text)
        return x @ self.weights[at] + self.weights[-1]

    def tell(self, features: Features, text: str | None) -> tuple[str, float]:
        """(language, its probability) of a text."""
        if not text or not has_letter(text):
            return UNDETERMINED, 0.0
        m = self.margins(features, text) / self.t
        p = np.exp(m - m.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, texts that have it) of a task's texts."""
    counts = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts[np.unique(np.concatenate([buckets(part) for part in _slices(text)]))] += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "docs"])


def _learner(held, shape: tuple[int, int], epoch: int):
    """What a part of the sample learns in an epoch from held, (chosen buckets, idf, z, n)."""

    def learn(table: pa.Table) -> pa.Table:
        chosen, idf, z, n = held.value
        features, own = Features(chosen, idf), FollowTheLeader(shape[0] - 1, shape[1], *(None if y is None else y.copy() for y in (z, n)))
        texts, labels = table["text"].to_pylist(), table["label"].to_pylist()
        place = table["place"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * epoch)
        for i in np.lexsort((labels, place)).tolist():  # another order each time, whatever order the rows come in
            own.learn(*features.vector(texts[i]), labels[i])
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "z": pa.array([own.z.tobytes()]), "n": pa.array([own.n.tobytes()])})

    return learn


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from about fit_rows texts of each language, held-out rows left aside; None if no row has a language."""
    spark = docs.sparkSession
    common.ship(spark)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    known = known.where(~is_held_out("id"))
    of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(of)
    if not languages:
        return None
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, fit_rows / of[k]) * 1_000_000)))])
    rows = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")]).select("text", "lang").distinct()
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    place = F.xxhash64("text", F.lit(1))
    rows = rows.select("text", number[F.col("lang")].alias("label"), place.alias("place"), F.pmod(place, F.lit(CALIBRATION)).alias("fold"))
    rows = common.stage(rows.where(F.col("text").rlike(r"\p{L}")), "language-fit")
    learned = rows.where("fold > 0")
    n_rows = learned.count()
    if not n_rows:  # too few texts to keep any for the temperature
        learned, n_rows = rows, rows.count()
    if len(languages) == 1 or not n_rows:
        return Model(languages, np.zeros(0, np.int64), np.zeros(0), np.zeros((1, len(languages))), 1.0)
    counted = learned.select("text").mapInArrow(_count_texts, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    best = counted.where(F.col("docs") >= (LEAST_DOCS if n_rows >= 100 else 1)).orderBy(F.col("docs").desc(), "bucket").limit(VOCABULARY).collect()
    chosen, idf = np.array([r["bucket"] for r in best], np.int64), np.log((1 + n_rows) / (1 + np.array([r["docs"] for r in best], float))) + 1
    shape, z, n = (len(chosen) + 1, len(languages)), None, None
    part = learned.withColumn("part", F.pmod(F.expr(f"place div {CALIBRATION}"), F.lit(max(1, min(PARTS, n_rows // PART_ROWS)))).cast("int"))
    for epoch in range(EPOCHS):
        held = spark.sparkContext.broadcast((chosen, idf, z, n))
        # as many rows as there are parts, of the size of the model
        got = sorted(part.groupBy("part").applyInArrow(_learner(held, shape, epoch), "part int, z binary, n binary").collect(), key=lambda r: r["part"])
        z, n = (sum(np.frombuffer(r[c]).reshape(shape) for r in got) / len(got) for c in ("z", "n"))
        held.unpersist()
    model = Model(languages, chosen, idf, FollowTheLeader(*shape, z, n).weights(), 1.0)
    held = spark.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = held.value.features()
        for batch in batches:
            got = [held.value.margins(features, t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column(1)], ["m", "label"])

    kept = rows.where("fold = 0").select("text", "label").mapInArrow(margins, "m array<double>, label int").collect()  # a share of the sample
    kept = sorted((r["label"], r["m"]) for r in kept)
    model.t = temperature(np.array([m for _, m in kept]), np.array([y for y, _ in kept], int))
    common.unstage(rows)
    return model


_held: dict[str, Features] = {}


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of docs."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(id_col, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("language_id", _held.clear)
        own = held.value
        if own.key not in _held:
            _held.clear()
            _held[own.key] = own.features()
        for batch in batches:
            got = [own.tell(_held[own.key], t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row of docs, by a model of its rows that aren't held out."""
    told = predict(docs, fit(docs, id_col, text_col, label_col, fit_rows), id_col, text_col)
    return told.select(id_col, is_held_out(id_col).alias("held_out"), "lang_pred", "score")
