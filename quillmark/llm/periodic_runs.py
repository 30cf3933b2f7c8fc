"""Maximal periodic runs of words, by divide and conquer at midpoints (Main and Lorentz).

A run is a stretch of words with smallest period q, of length >= max(least, times * q), that no neighbouring word
extends. Words are interned to numbers. A run that lies in a segment either crosses its midpoint or lies in one half;
of one that crosses, at least one period lies wholly to one side, so two Z-functions (of the right half against the
segment, and of both reversed) give, for each period, how far the repetition reaches both ways. What touches the border
of a segment and goes on behind it was found where that border was the midpoint; equal stretches keep their smallest
period (a stretch of three periods or more that is maximal for a multiple of its period is maximal for the period).

Segments without enough places that come back within a third of their length hold no run and are left out: all words
of a run but the last period start a window of words that follows again one period later. Inside a run of a short
period there is no other run long enough, so such segments are left out too. Work is n log n at most for n words.

Null text counts as empty: no runs, empty collapsed text. Texts are whole, however long; null and repeated ids are
rows like any other, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common

#: Shortest run in words; fewest periods in a run; words of the windows by which segments are left out.
LEAST, TIMES, WINDOW = 24, 3, 8

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def z_function(s: np.ndarray, upto: int) -> np.ndarray:
    """For each place i < upto, how many elements s[i:] and s have in common at their beginnings. Only places that
    begin like s are walked."""
    z = np.zeros(upto, np.int64)
    z[:1] = len(s)
    places = np.flatnonzero(s[1:upto] == s[0]) + 1 if len(s) else []
    if not len(places):
        return z
    a, n, left, right = s.tolist(), len(s), 0, 0
    got: dict[int, int] = {}
    for i in places.tolist():
        k = 0
        if i < right:
            k = got.get(i - left, 0)
            if k < right - i:
                got[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        got[i] = k
        left, right = i, i + k
    z[list(got)] = list(got.values())
    return z


def _comes_back(s: np.ndarray) -> np.ndarray | None:
    """Distance from each place to the next one with an equal window (by hash: equal windows are never missed), or
    None if no window comes back."""
    n = len(s) - WINDOW + 1
    if n < 2:
        return None
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + s[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return None
    back = np.full(n, len(s), np.int64)
    back[order[same]] = order[same + 1] - order[same]
    return back


def _crossing(s: np.ndarray, lo: int, mid: int, hi: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of what repeats across mid, maximal within the segment."""
    u, v, gap = s[lo:mid], s[mid:hi], np.array([-1])
    nu, nv, most = len(u), len(v), (hi - lo) // times
    fore = z_function(np.concatenate([v, gap, u, v]), nv + 1 + nu)
    back = z_function(np.concatenate([u[::-1], gap, v[::-1], u[::-1]]), nu + 1 + nv)
    # one period to the right of mid: matches from mid on and before it, at distance q
    q = np.arange(1, min(nv, most) + 1)
    start, end = mid - back[nu + 1 + nv - q], mid + q + np.where(q < nv, fore[np.minimum(q, nv - 1)], 0)
    ok = end - start >= np.maximum(least, times * q)
    yield from zip(start[ok].tolist(), end[ok].tolist(), q[ok].tolist(), strict=True)
    # one period to the left of it
    q = np.arange(1, min(nu, most) + 1)
    start, end = mid - q - np.where(q < nu, back[np.minimum(q, nu - 1)], 0), mid + fore[nv + 1 + nu - q]
    ok = end - start >= np.maximum(least, times * q)
    yield from zip(start[ok].tolist(), end[ok].tolist(), q[ok].tolist(), strict=True)


def find_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    n = len(words)
    # windows of a run that come back one period later; it takes one at least for the windows to tell anything
    enough = -(-least * (times - 1) // times) - WINDOW + 1
    if n < least:
        return []
    number: dict = {}
    s = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    back = _comes_back(s) if enough > 0 and len(number) > 1 else np.ones(n, np.int64)
    if back is None:
        return []
    found: dict[tuple[int, int], int] = {}
    calm: list[tuple[int, int]] = []
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < least or np.count_nonzero(back[lo:hi] <= (hi - lo) // times) < max(1, enough) or any(a <= lo and hi <= b for a, b in calm):
            continue
        mid = (lo + hi) // 2
        for a, b, q in _crossing(s, lo, mid, hi, least, times):
            if a == lo and lo and s[lo - 1] == s[lo - 1 + q] or b == hi and hi < n and s[hi] == s[hi - q]:
                continue  # part of a longer one, found before
            if q < found.get((a, b), n):
                found[a, b] = q
            # another run inside has a period under q / 2 and goes past it by less: it is shorter than 1.5 * q
            if 3 * q <= 2 * least and (a, b) not in calm:
                calm.append((a, b))
        stack += [(lo, mid), (mid, hi)]
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs (start, length, period) in words, by start, then period,
    and its words without what repeats, joined by a space. times is 3 at least."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("periodic_runs")
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                rows = batch.slice(x, 500)
                n, runs, kept = [], [], []
                for text in rows.column(1).to_pylist():
                    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
                    own = find_runs(words, least, times)
                    n.append(len(words))
                    runs.append([{"start": a, "length": k, "period": q} for a, k, q in own])
                    kept.append(b" ".join(collapse(words, own)).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(runs, RUNS), pa.array(kept, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    schema = f"`{id_col}` long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def words_of(text) -> Column:
    """The words of a text, split at ASCII white space; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a repetition put into the text of each tenth id (by crc32 of the id as text, h, with g = h / 10): from
    word a = g % n on, the p = 1 + (n - a) / (3 + g % 8) words there repeat to the end. Rows without an id or a word
    stay as they are."""
    h, words = F.crc32(F.col(id_col).cast("string").cast("binary")), words_of(F.col(text_col))
    g, n = F.floor(h / 10), F.size(words)
    a = F.expr("cast(g % n as int)")
    p = F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)")
    # the words are cut from arrays, not looked up one by one, so that a text is split a fixed number of times
    block = F.slice(words, F.col("a") + 1, F.col("p"))
    rest = F.slice(F.flatten(F.array_repeat(block, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    made = F.concat_ws(" ", F.slice(words, F.lit(1), F.col("a")), rest)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.when(h % 10 == 0, g).alias("g"), F.when(h % 10 == 0, n).otherwise(0).alias("n"))
    out = out.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    return out.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias(text_col))


def run_digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From periodic_runs: (id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), the four
    of the run of the greatest length / period (ties: smallest start, then period)."""
    # length / period is compared exactly, by cross products
    best = F.aggregate("runs", F.element_at("runs", 1), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    some = docs.withColumn("best", F.when(F.size("runs") > 0, best))
    return some.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same rows in DuckDB: places with an equal word at distance q, their unbroken stretches, the smallest q of each.
SQL = r"""
with crc as (select doc_id, text, xor(list_reduce([x for x in list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as ubigint))],
    lambda c, b: list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), cast(4294967295 as ubigint)), cast(4294967295 as ubigint)) as h from documents),
docs as (select row_number() over () as r, doc_id, h, h // 10 as g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from crc),
cut as (select *, case when h % 10 = 0 and len(w) > 0 then cast(g % len(w) as bigint) end as a from docs),
per as (select *, cast(1 + (len(w) - a) // (3 + g % 8) as bigint) as p from cut),
texts as (select r, doc_id, case when a is null then w else list_transform(range(len(w)), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) end as w from per),
words as (select r, len(w) as n, unnest(range(len(w))) as i, unnest(w) as word from texts),
pairs as (select x.r, x.i, y.i - x.i as q from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 3),
likely as (select r, q from pairs group by r, q having count(*) >= greatest(24 - q, 2 * q)),
islands as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from pairs semi join likely using (r, q)),
stretches as (select r, q, min(i) as start, count(*) + q as length from islands group by r, q, island having count(*) + q >= greatest(24, 3 * q)),
runs as (select r, start, length, min(q) as period from stretches group by r, start, length),
best as (select r, arg_max({'start': start, 'length': length, 'period': period}, {'e': cast(length as double) / period, 's': -start, 'p': -period}) as b from runs group by r),
lines as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by r),
gone as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (select r, string_agg(word, ' ' order by i) as kept from words anti join gone using (r, i) group by r)
select t.doc_id, coalesce(l.n_runs, 0) as n_runs, cast(b.b.start as bigint) as start, cast(b.b.length as bigint) as length, cast(b.b.period as bigint) as period,
    cast(1000 * b.b.length // b.b.period as bigint) as exponent_milli, sha256(coalesce(l.lines, '')) as runs_sha256, sha256(coalesce(k.kept, '')) as collapsed_sha256
from texts t left join lines l using (r) left join best b using (r) left join kept k using (r)
"""
