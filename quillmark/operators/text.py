"""Model responses, rubrics and transcription text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import scalar as S
from quillmark.functions.python_parity import edit_distance, word_edit_distance

CRITERIA = "array<struct<name:string,max_points:double,levels:array<struct<label:string,points:double,description:string>>>>"
# Phrases that tell a corrected text that talks about itself.
RUNAWAY = (
    "here is the reformatted", "the above response", "does not match", "does not seem correct",
    "a possible correction is", "let me", "as an ai", "i apologize",
)


# Patterns of score, feedback and confidence in a reply that is no JSON, and of one criterion's object.
LOOSE = (r'"score"\s*:\s*([\d.]+)', r'"feedback"\s*:\s*"([^"]+)"', r'"confidence"\s*:\s*([\d.]+)')
LOOSE_ITEM = r'(\{[^{}]*"criterion"[^{}]*\})'


def parse_response(raw: Column | str, most: Column | str) -> Column:
    """struct(score, feedback, confidence) of a model's reply: a JSON object with both score and feedback, else what
    patterns find in the raw reply (feedback up to the first quotation mark); scores are clamped to [0, most], confidences to [0, 1]; 1 where none is given, feedback's default is
    the reply's first 400 characters."""
    raw = S.col(raw)
    text = S.without_fences(raw)
    j = F.from_json(text, "score string, feedback string, confidence string", {"mode": "PERMISSIVE"})
    strict = F.startswith(F.ltrim(text), F.lit("{")) & j["score"].isNotNull() & j["feedback"].isNotNull() & S.number(j["score"]).isNotNull()
    score, feedback, confidence = (F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in LOOSE)
    score = F.when(strict, S.number(j["score"])).otherwise(score.try_cast("double"))
    feedback = F.when(strict, j["feedback"]).otherwise(feedback)
    confidence = F.when(strict, S.number(j["confidence"])).otherwise(confidence.try_cast("double"))
    return F.struct(
        S.clamp(F.coalesce(score, F.lit(0.0)), 0.0, S.col(most)).alias("score"), F.coalesce(feedback, F.substring(raw, 1, 400)).alias("feedback"),
        S.clamp(F.coalesce(confidence, F.lit(1.0)), 0.0, 1.0).alias("confidence"),
    )


def level_bands(levels: Column, most: Column) -> Column:
    """array<struct(label, lower, upper)> from levels with label and points: by falling points, borders half-way
    between neighbours, the top reaching most and the bottom 0."""
    ranked = F.array_sort(F.transform(levels, lambda x, i: F.struct((-x["points"]).alias("p"), i.alias("i"), x["label"].alias("label"))))

    def parted(ranked: Column) -> Column:
        n = F.size(ranked)
        point = lambda i: -F.get(ranked, i)["p"]
        lower = lambda i: F.when(i == n - 1, F.lit(0.0)).otherwise((point(i) + point(i + 1)) / 2)
        return F.transform(ranked, lambda x, i: F.struct(x["label"].alias("label"), lower(i).alias("lower"), F.when(i == 0, most).otherwise(lower(i - 1)).alias("upper")))

    return S.let(ranked, parted)


def level_of(bands: Column, score: Column) -> Column:
    """Label of the first band that holds the score, so borders go up; else the last label."""
    hit = F.filter(bands, lambda b: (score >= b["lower"] - 1e-9) & (score <= b["upper"] + 1e-9))
    return F.coalesce(F.get(hit, F.lit(0))["label"], F.get(bands, F.size(bands) - 1)["label"])


def criterion_max(criteria: Column) -> Column:
    """Points of an exam question from its criteria: sum of each one's highest level, 0 for one without levels."""
    tops = F.transform(criteria, lambda c: F.coalesce(F.array_max(F.transform(c["levels"], lambda x: x["points"])), F.lit(0.0)))
    return F.aggregate(tops, F.lit(0.0), lambda a, x: a + x)


def match_criteria(criteria: DataFrame, responses: DataFrame) -> DataFrame:
    """criteria (id, pos, name, max_points) with their response (id, pos, name, score, confidence): by name, case and
    outer blanks aside, the last of equal names, blank ones aside; else the one at the same place; else score 0 and
    confidence 0. A response without a score counts 0, one without a confidence 1."""
    key = F.lower(S.strip("name"))
    by_name = responses.where(key != "").groupBy("id", key.alias("__k")).agg(F.max_by(F.struct("score", "confidence"), "pos").alias("__n"))
    by_pos = responses.groupBy("id", "pos").agg(F.max(F.struct("score", "confidence")).alias("__p"))
    rows = criteria.withColumn("__k", key).join(by_name, ["id", "__k"], "left").join(by_pos, ["id", "pos"], "left")
    r = F.coalesce("__n", "__p")
    confidence = F.when(r.isNull(), 0.0).otherwise(F.coalesce(r["confidence"], F.lit(1.0)))
    return rows.select("id", "pos", "name", "max_points", S.clamp(F.coalesce(r["score"], F.lit(0.0)), 0.0, F.col("max_points")).alias("score"), S.clamp(confidence, 0.0, 1.0).alias("confidence"), r.isNull().alias("missing"))


# What results say where a model said nothing; length from which feedback is cut.
NO_RESPONSE, NO_REASON = "(no response for this criterion — review manually)", "(no justification provided)"
MOST_FEEDBACK = 1500


def structured_items(raw: Column | str) -> Column:
    """array<struct(criterion, score, confidence, justification)>, as strings, of a model's reply: the objects of a
    JSON array, else the flat objects anywhere in it that have a criterion. A lone object is no array."""
    raw = S.col(raw)
    text, item = S.without_fences(raw), "struct<criterion:string,score:string,confidence:string,justification:string>"
    whole = S.let(text, lambda t: F.when(F.startswith(F.ltrim(t), F.lit("[")), F.from_json(t, f"array<{item}>")))
    parts = F.transform(F.regexp_extract_all(raw, F.lit(LOOSE_ITEM), F.lit(1)), lambda x: F.from_json(x, item))
    there = lambda items: F.filter(items, lambda x: x.isNotNull())
    return S.let(there(whole), lambda found: F.when(F.size(found) > 0, found).otherwise(there(parts)))


def structured_scores(criteria: Column | str, items: Column | str) -> Column:
    """array<struct(criterion, max_points, score, confidence, justification, level)>, one for each of criteria (of type
    CRITERIA): by name as match_criteria, else by place, else nothing; the level follows from the clamped score."""
    criteria, items = S.col(criteria), S.col(items)
    fold = lambda c: F.lower(S.strip(F.coalesce(c, F.lit(""))))

    def scored(c: Column, name: Column, it: Column) -> Column:
        most, has_levels = F.coalesce(c["max_points"], F.lit(0.0)), F.coalesce(F.size(c["levels"]), F.lit(0)) > 0
        score = F.when(it.isNull(), 0.0).otherwise(S.clamp(F.coalesce(S.number(it["score"]), F.lit(0.0)), 0.0, most))
        sure = F.when(it.isNull(), 0.0).otherwise(S.clamp(F.coalesce(S.number(it["confidence"]), F.lit(1.0)), 0.0, 1.0))
        said = F.when(it.isNull(), NO_RESPONSE).otherwise(F.coalesce(F.nullif(S.strip(it["justification"]), F.lit("")), F.lit(NO_REASON)))
        band = lambda score: S.let(level_bands(c["levels"], most), lambda bands: F.when(it.isNull(), F.get(bands, F.size(bands) - 1)["label"]).otherwise(level_of(bands, score)))
        level = lambda score: F.when(has_levels, band(score)).otherwise("")
        return S.let(score, lambda v: F.struct(name.alias("criterion"), most.alias("max_points"), v.alias("score"), sure.alias("confidence"), said.alias("justification"), level(v).alias("level")))

    def one(rows: Column, c: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(c["name"], F.lit("")), F.concat(F.lit("Criterion "), (i + 1).cast("string")))
        named = lambda key: F.filter(rows, lambda x: (x["key"] == key) & (x["key"] != ""))
        chosen = lambda own: F.coalesce(F.get(own, F.size(own) - 1), F.get(rows, i))["item"]
        return S.let(name, lambda name: S.let(S.let(S.let(fold(name), named), chosen), lambda it: scored(c, name, it)))

    keyed = F.transform(items, lambda x: F.struct(fold(x["criterion"]).alias("key"), x.alias("item")))
    return S.let(keyed, lambda rows: F.transform(criteria, lambda c, i: one(rows, c, i)))


def criteria_feedback(scores: Column | str) -> Column:
    """`name: score/points (level) — justification`, parted by `; `, cut where it is too long."""
    part = lambda x: F.concat(x["criterion"], F.lit(": "), S.general(x["score"]), F.lit("/"), S.general(x["max_points"]), F.when(x["level"] != "", F.concat(F.lit(" ("), x["level"], F.lit(")"))).otherwise(""), F.lit(" — "), x["justification"])
    text = F.array_join(F.transform(S.col(scores), part), "; ")
    return S.let(text, lambda text: F.when(F.length(text) > MOST_FEEDBACK, F.concat(F.substring(text, 1, MOST_FEEDBACK - 3), F.lit("..."))).otherwise(text))


# The line forms of criteria_prompt and criteria_feedback are fixed values too: what a model is told, and what is shown.
def criteria_prompt(criteria: Column | str) -> Column:
    """A line for each criterion, and under it one for each of its levels with the band of scores that it covers."""

    def one(c: Column) -> Column:
        most = F.coalesce(c["max_points"], F.lit(0.0))
        ranked = F.array_sort(F.transform(c["levels"], lambda x, i: F.struct((-x["points"]).alias("p"), i.alias("i"), x["description"].alias("description"))))
        head = F.concat(F.lit("### "), F.coalesce(c["name"], F.lit("Criterion")), F.lit(" (score 0–"), S.general(most), F.lit(" pts)"))
        line = lambda b, i: F.concat(F.lit("- "), b["label"], F.lit(": score "), S.general(b["lower"]), F.lit("-"), S.general(b["upper"]), F.lit(" pts — "), F.coalesce(F.get(ranked, i)["description"], F.lit("")))
        return F.concat(F.array(head), F.coalesce(F.transform(level_bands(c["levels"], most), line), F.array().cast("array<string>")))

    return F.array_join(F.flatten(F.transform(S.col(criteria), one)), "\n")


def correction_prompt(question_type: Column | str, queued: bool = False) -> Column:
    """Which prompt corrects a recognised text: essay, short or none; queued work takes the essay one for short
    answers too. An unknown question counts as an essay."""
    kind = F.coalesce(S.col(question_type), F.lit("essay"))
    return F.when(kind.isin("mcq", "tf"), F.lit(None).cast("string")).when(F.lit(not queued) & (kind == "identification"), "short").otherwise("essay")


def is_runaway(raw: Column | str, corrected: Column | str) -> Column:
    """Whether a corrected text holds a telltale phrase or has outgrown its source."""
    c = F.lower(S.col(corrected))
    said = F.array_contains(F.transform(F.array(*map(F.lit, RUNAWAY)), lambda p: F.contains(c, p)), True)
    return said | (F.length(S.col(corrected)) > F.greatest(F.lit(200), 3 * F.length(S.col(raw))))


def qr_payload(raw: Column | str) -> Column:
    """struct(exam_id, student_id) of a code's text; null if it isn't such JSON."""
    return F.from_json(S.col(raw), "exam_id bigint, student_id string")


#: Sizes of two texts, multiplied, from which edit distances in characters, and in words, are counted in batches outside
#: the built-in expressions: those make the whole table, with a limit on the distance too, and look each word up in a
#: list.
LONG, LONG_IN_WORDS = 40_000, 40_000


def _is_long(reference: Column, given: Column, limit: int) -> Column:
    return F.length(reference).cast("long") * F.length(given) > limit


def cer(reference: Column | str, given: Column | str) -> Column:
    """Character error rate as S.cer(), of texts of any length."""
    r, g = S.col(reference), S.col(given)
    long = _is_long(r, g, LONG)
    return F.when(long, edit_distance(F.when(long, r), F.when(long, g)).cast("double") / F.length(r)).otherwise(S.cer(F.when(~long, r), F.when(~long, g)))


def wer(reference: Column | str, given: Column | str) -> Column:
    """Word error rate as S.wer(), of texts of any length."""
    r, g = S.col(reference), S.col(given)
    long, n = _is_long(r, g, LONG_IN_WORDS), F.size(S.words(r))
    many = F.when(n == 0, F.lit(0.0)).otherwise(word_edit_distance(F.when(long, r), F.when(long, g)).cast("double") / n)
    return F.when(long, many).otherwise(S.wer(F.when(~long, r), F.when(~long, g)))


def transcription_quality(pairs: DataFrame, reference="ref", given="hyp") -> DataFrame:
    return pairs.withColumn("cer", cer(reference, given)).withColumn("wer", wer(reference, given))
