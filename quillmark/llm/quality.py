"""Quality rules of documents and of their hosts, in DataFrame functions only.

Rules on a text's words `[^\\x20\\x09-\\x0D]+` decide base_failed. Failures are counted by host (the source); a host's
failure rate is shrunk towards that of all hosts by a beta prior fit to them by moments (the rates' mean and
variance, both weighted by rows): (failed + a) / (rows + a + b). A host over HOST_LIMIT is rejected, and with it its
documents; the verdicts are joined back to the documents.

Windows of a text are compared by 64-bit hashes. Null text counts as empty and fails; a null source is a host of its
own; null and repeated ids are rows like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common

#: Rules: fewest words; most percent of words in repeated windows; words of a window. Host: highest shrunk rate.
LEAST_WORDS, MOST_REPEATED, WINDOW, HOST_LIMIT = 20, 30, 8, 0.5
#: Where verdicts are joined, a host of more rows is dealt over several keys of at most so many; there are at most
#: MOST_HOT such hosts, for which rows of a key grow with the table.
KEY_ROWS, MOST_HOT = 2_000, 200_000
#: Bytes of rejected hosts up to which they are sent to all tasks.
MOST_SENT = 8 << 20

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed; the text is read
    once, and what several expressions need stands in a projection of its own. Stage the result before filtering it.
    docs must not have these names, nor names that begin with two underscores."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns]
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_without(x, _SPACE)) > 0)
    one = docs.select(
        *own,
        F.transform(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), ""), lambda w: F.xxhash64(w)).alias("__w"),
        F.length(_without(text, _SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    seven = ["word_chars", "n_symbols"]
    # __w and __l are used twice each below, so the optimizer keeps them in a projection of their own
    windows = F.when(F.size("__w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))))
    two = one.select(*own, *seven, F.size("__w").cast("long").alias("n_words"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), windows.alias("__h"))
    seven += ["n_words", "n_dup_lines"]
    again = F.size("__h") > F.size(F.array_distinct("__h"))
    # windows by hash, with their places: equal ones are neighbours
    three = two.select(*own, *seven, F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    n = F.size("__s")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    zipped = F.arrays_zip(F.col("__s").alias("s"), F.concat(none, F.slice("__s", F.lit(1), n - 1)).alias("p"), F.concat(F.slice("__s", F.lit(2), n - 1), none).alias("q"))
    twice = F.filter(zipped, lambda x: F.coalesce(x["s"]["h"] == x["p"]["h"], F.lit(False)) | F.coalesce(x["s"]["h"] == x["q"]["h"], F.lit(False)))
    four = three.select(*own, *seven, F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["s"]["i"]))).alias("__p"))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    cover = F.aggregate("__p", start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")), lambda a: a["n"])
    five = four.select(*own, *seven, F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return five.withColumn("base_failed", (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words))


def host_verdicts(failures: DataFrame, host_col: str, failed_col: str, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, rows, failed, rate, host_rejected): one row for each host; rate is the shrunk failure rate."""
    hosts = failures.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("rows"), F.count_if(failed_col).alias("failed"))
    hosts = common.stage(hosts, "quality-hosts")
    rows, failed = F.col("rows").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.sum("rows").alias("n"), F.sum("failed").alias("f"), F.sum(failed * failed / rows).alias("ff")).first()
    n, f = sums["n"] or 1, sums["f"] or 0
    mean = f / n
    spread = max(0.0, (sums["ff"] or 0.0) / n - mean * mean)
    a, b = prior(mean, spread)
    rate = (failed + a) / (rows + (a + b))
    return hosts.select("host", "rows", "failed", rate.alias("rate"), (rate > limit).alias("host_rejected"))


def prior(mean: float, spread: float) -> tuple[float, float]:
    """Beta prior with that mean and variance, of a weight from 1 to a million rows."""
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else 1e6
    weight = min(max(weight, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def _dealt(rows: DataFrame, hosts: DataFrame, host_col: str) -> tuple[DataFrame, DataFrame]:
    """rows and hosts (host, rows, ...) with a __key each, to be joined by host and __key: a host has as many keys as its
    rows want, and each of its rows one of them. What all tasks get is 12 bytes for each host of many rows, of which
    there are at most MOST_HOT; hosts are known by a hash there, alike on both sides."""
    each = max(KEY_ROWS, -(-(hosts.agg(F.sum("rows")).first()[0] or 0) // MOST_HOT))
    many = hosts.where(F.col("rows") > each).groupBy(F.xxhash64("host").alias("__hash")).agg(F.max(F.ceil(F.col("rows") / each)).cast("int").alias("__keys"))
    many = F.broadcast(common.stage(many, "quality-keys"))
    keys = F.coalesce("__keys", F.lit(1))
    dealt = rows.join(many, F.xxhash64(host_col) == F.col("__hash"), "left").withColumn("__key", F.pmod(F.monotonically_increasing_id(), keys).cast("int"))
    spread = hosts.join(many, F.xxhash64("host") == F.col("__hash"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), keys - 1)))
    return dealt.drop("__hash", "__keys"), spread.drop("__hash", "__keys", "rows")


def _with_verdict(rows: DataFrame, verdicts: DataFrame, host_col: str) -> DataFrame:
    """rows with host_rate and host_rejected; the rows of a host are spread over as many keys as they want."""
    dealt, spread = _dealt(rows, verdicts.select("host", "rows", F.col("rate").alias("host_rate"), "host_rejected"), host_col)
    return dealt.join(spread, dealt[host_col].eqNullSafe(spread["host"]) & (dealt["__key"] == spread["__part"])).drop("host", "__key", "__part")


def _without_hosts(rows: DataFrame, bad: DataFrame, host_col: str) -> DataFrame:
    """rows whose host isn't among bad (host, rows; hosts distinct). Where the names take at most MOST_SENT bytes they are
    sent to all tasks and no row moves; else a host's rows are spread over as many keys as they want."""
    bad = common.stage(bad, "quality-bad")
    if (bad.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 64)).first()[0] or 0) <= MOST_SENT:
        sent = F.broadcast(bad)
        return rows.join(sent, rows[host_col].eqNullSafe(sent["host"]), "left_anti")
    dealt, spread = _dealt(rows, bad, host_col)
    return dealt.join(spread, dealt[host_col].eqNullSafe(spread["host"]) & (dealt["__key"] == spread["__part"]), "left_anti").drop("__key")


def rate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"), F.col(host_col).alias("__host"))
    rated = common.stage(features(rows).drop("text"), "quality-rated")
    out = _with_verdict(rated, host_verdicts(rated, "__host", "base_failed"), "__host")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(id_col, *names, (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rate")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, that neither their text nor their host gets rejected.

    Columns go by their place here, so that any names can stand in docs. The rules' verdict is staged with the rows: a
    filter on a computed one would be pushed below, and copied into, the projections that it is made in. Null texts
    fail, a null host is a host of its own, equal rows are judged alike and all kept, an empty table gives no rows;
    the work is linear in a text's words but for one sort of its windows' hashes."""
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, host = (f"c{names.index(c)}" for c in (text_col, host_col))
    rated = common.stage(features(rows, text).select(*rows.columns, "base_failed"), "quality-judged")
    bad = host_verdicts(rated, host, "base_failed").where("host_rejected").select("host", "rows")
    return _without_hosts(rated.where("not base_failed").select(*rows.columns), bad, host).toDF(*names)


#: DuckDB SQL with the rows of rate_documents over the view documents, but for host_rate.
FEATURES_SQL = r"""
w as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from {docs}),
g as (select r, i, count(*) over (partition by r, k) as c from (select r, unnest(range(1, len(ws) - 6)) as i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) as k from w where len(ws) >= 8)),
v as (select r, cast(sum(least(8, i - coalesce(b, -7))) as bigint) as n from (select r, i, lag(i) over (partition by r order by i) as b from g where c > 1) group by r),
l as (select r, cast(count(*) - count(distinct x) as bigint) as n from (select r, unnest(string_split(text, chr(10))) as x from w) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
b as (select doc_id, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(v.n, 0) as n_repeat_words, w.r
  from w left join v on v.r = w.r left join l on l.r = w.r),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b),
h as (select source, count(*) as n, count(*) filter (base_failed) as f from f group by source),
m as (select sum(f) / sum(n) as mean, greatest(0, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n))) as spread from h),
p as (select mean, case when spread > 0 then least(greatest(mean * (1 - mean) / spread - 1, 1), 1e6) else 1e6 end as weight from m),
bad as (select source from h, p where (f + mean * weight) / (n + weight) > 0.5)"""
SQL = "with " + FEATURES_SQL.format(docs="documents") + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from bad where bad.source is not distinct from f.source) as kept
from f"""
