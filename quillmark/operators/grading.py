"""Deterministic scoring of answers, automatic flags and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import scalar as S
from quillmark.functions.rounding import with_rounded
from quillmark.functions.python_parity import match_ratio
from quillmark.operators.text import cer, wer

# Texts and thresholds that results must carry.
MULTIPLE = "Multiple bubbles marked"
LOW_MARK_CONFIDENCE, LOW_ESSAY_CONFIDENCE = 0.30, 0.4
FUZZY_FULL, FUZZY_PARTIAL = 0.85, 0.60
FILLED = 0.12


def score_objective(df: DataFrame, text="ocr_text", correct="correct_answer", most="max_points", confidence="omr_confidence") -> DataFrame:
    """df with score, new_status and flag of mcq and tf answers; all null where there is no text.

    A multi-mark text scores 0 and is flagged. Else the first word or the whole text must equal the correct answer,
    case and outer white space aside. Low mark confidence wants a review, then blank text does."""
    t, whole = S.strip(text), S.fold(text)
    multiple, ok = t == MULTIPLE, S.has_text(text)
    right = S.fold(F.coalesce(correct, F.lit("")))
    hit = (whole == right) | (F.upper(S.first_word(text)) == right)
    low = F.coalesce(F.col(confidence) < LOW_MARK_CONFIDENCE, F.lit(False))
    blank = F.length(t) == 0
    return df.select(
        "*", F.when(ok & multiple, 0.0).when(ok, F.when(F.coalesce(hit, F.lit(False)), F.coalesce(most, F.lit(1.0))).otherwise(0.0)).alias("score"),
        F.when(ok, F.when(multiple | low | blank, "needs_review").otherwise("graded")).alias("new_status"),
        F.when(ok & multiple, "omr_multiple_marks").when(ok & low, "omr_low_confidence").when(ok & blank, "omr_no_detection").alias("flag"),
    )


def score_identification(df: DataFrame, text="ocr_text", correct="correct_answer", most="max_points", full: float = FUZZY_FULL, partial: float = FUZZY_PARTIAL) -> DataFrame:
    """df with ratio, score, verdict and flag: equal texts, or near ones by the share of matching blocks, get full
    points, less near ones half; a question without points counts 1. The ratio is computed only where texts differ."""
    given, want = F.lower(S.strip(text)), F.lower(S.strip(F.coalesce(correct, F.lit(""))))
    same = given == want
    rows = df.withColumn("__r", F.when(S.has_text(text) & ~same, match_ratio(F.when(~same, want), F.when(~same, given))))
    r, ok, points = F.coalesce("__r", F.lit(1.0)), S.has_text(text), F.coalesce(F.col(most), F.lit(1.0))
    return rows.select(
        "*", F.when(ok, r).alias("ratio"), F.when(ok, F.when(r >= full, points).when(r >= partial, points * 0.5).otherwise(0.0)).alias("score"),
        F.when(ok, F.when(same, "exact").when(r >= full, "close").when(r >= partial, "partial").otherwise("none")).alias("verdict"),
    ).drop("__r").withColumn("flag", F.when(F.col("score") == 0, "identification_no_match"))


# The sentences of feedback, first as a single answer gets them, then as bulk and queued work writes them.
EXPECTED, GIVEN, EXACT = "Expected: ", ". Your answer: ", "Exact match."
VERDICTS = {"close": ("Accepted", "accepted"), "partial": ("Partial credit", "partial"), "none": ("Incorrect", "incorrect")}
SHARE = (" (fuzzy match ", " (fuzzy ")
RIGHT_ANSWER, DETECTED = "Correct answer: ", (". Detected answer: ", ". Detected: ")
MANY = "multiple bubbles marked. Incorrect — more than one option was filled in, so no single answer can be credited. ⚠ Please verify on the original scan."
UNSURE = (") — please verify on the original scan.", ").")


def objective_feedback(text="ocr_text", correct="correct_answer", confidence="omr_confidence", bulk: bool = False) -> Column:
    """What a scored mcq or tf answer says; null where there is no text. Bulk work has shorter sentences, and none for an
    answer that wasn't detected."""
    given, right = S.strip(text), S.col(correct)
    hit = (S.fold(text) == S.fold(F.coalesce(right, F.lit("")))) | (F.upper(S.first_word(text)) == S.fold(F.coalesce(right, F.lit(""))))
    start = F.concat(F.lit(RIGHT_ANSWER), F.coalesce(right, F.lit("None")), F.lit(DETECTED[bulk]))
    low = F.coalesce(F.col(confidence) < LOW_MARK_CONFIDENCE, F.lit(False))
    warn = F.when(low, F.concat(F.lit(" ⚠ Low OMR confidence ("), S.percent(confidence), F.lit(UNSURE[bulk]))).when((F.length(given) == 0) & F.lit(not bulk), " ⚠ No answer detected — please review.").otherwise("")
    one = F.concat(start, F.coalesce(F.nullif(given, F.lit("")), F.lit("(none)")), F.lit(". "), F.when(F.coalesce(hit, F.lit(False)), "Correct.").otherwise("Incorrect."), warn)
    return F.when(S.has_text(text), F.when(given == MULTIPLE, F.concat(start, F.lit(MANY))).otherwise(one))


def identification_feedback(text="ocr_text", correct="correct_answer", ratio="ratio", verdict="verdict", bulk: bool = False) -> Column:
    """What a scored identification answer says: its expected and given text and the verdict with the ratio."""
    share = F.concat(F.lit(SHARE[bulk]), S.percent(ratio), F.lit(")."))
    said = F.when(F.col(verdict) == "exact", F.lit(EXACT))
    for kind, (word, _) in VERDICTS.items():
        said = said.when(F.col(verdict) == kind, F.concat(F.lit(word), share))
    return F.concat(F.lit(EXPECTED), S.strip(F.coalesce(S.col(correct), F.lit(""))), F.lit(GIVEN), S.strip(text), F.lit(". "), said)


def parse_identification(feedback="feedback") -> Column:
    """struct(expected, given, percent, kind) of such a sentence, of either wording; null where it is none. The pattern
    is made of the words that the sentence is made of."""
    c, p = S.col(feedback), rf"(?s)^{EXPECTED.strip()}\s*(.*?)\{GIVEN.strip().replace(' ', chr(92) + 's*', 1)}\s*(.*?)\.\s*(.*)$"
    verdict = F.regexp_extract(c, p, 3)
    kind = F.when(verdict.rlike(f"(?i)^{EXACT.rstrip('.')}"), "exact")
    for word, name in list(VERDICTS.values())[:-1]:
        kind = kind.when(verdict.rlike(f"(?i)^{word}"), name)
    share = F.nullif(F.regexp_extract(verdict, r"(\d+)%", 1), F.lit("")).cast("int")
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("expected"), F.regexp_extract(c, p, 2).alias("given"), share.alias("percent"), kind.otherwise("incorrect").alias("kind")))


def bubble_override(label="label", correct="correct_answer", most="max_points") -> Column:
    """Score of a bubble that a teacher picks: all points if it is the correct answer, else 0."""
    fold = lambda c: F.upper(S.strip(F.coalesce(S.col(c), F.lit(""))))
    return F.when(fold(label) == fold(correct), F.col(most)).otherwise(0.0)


def essay_failure(answers: DataFrame, failed: DataFrame, each: bool = True) -> DataFrame:
    """answers with status and feedback after failed calls (id, message). Each answer alone: status `error`, the
    message as feedback, and the others keep theirs. Else, as in bulk and queued work, a submission with a failed
    answer fails whole: its answers get the status `failed`."""
    one = failed.groupBy("id").agg(F.min("message").alias("__m"))
    rows = answers.join(one, "id", "left")
    rest = [c for c in answers.columns if c not in ("status", "feedback")]
    if each:
        return rows.select(*rest, F.when(F.col("__m").isNotNull(), "error").otherwise(F.col("status")).alias("status"), F.when(F.col("__m").isNotNull(), F.concat(F.lit("[Grading error: "), "__m", F.lit("]"))).otherwise(F.col("feedback")).alias("feedback"))
    bad = rows.where("__m is not null").select("submission_id").distinct().withColumn("__bad", F.lit(True))
    return rows.join(bad, "submission_id", "left").select(*rest, F.when(F.col("__bad"), "failed").otherwise(F.col("status")).alias("status"), F.col("feedback"))


def flag_by_hand(flags: DataFrame, new: DataFrame) -> DataFrame:
    """flags (submission_answer_id, flag_reason, auto_flagged, ...) after a teacher's flags (submission_answer_id,
    flag_reason): new or not, the answer's flag has that reason and isn't automatic any more; of several reasons for an
    answer the greatest counts."""
    one = new.groupBy("submission_answer_id").agg(F.max("flag_reason").alias("__r"))
    rest = [c for c in flags.columns if c not in ("submission_answer_id", "flag_reason", "auto_flagged")]
    return flags.join(one, "submission_answer_id", "full").select("submission_answer_id", F.coalesce("__r", "flag_reason").alias("flag_reason"), F.when(F.col("__r").isNotNull(), F.lit(False)).otherwise(F.col("auto_flagged")).alias("auto_flagged"), *rest)


def essay_flag(score="score", confidence="confidence", question="question_id", fallback="fallback_id") -> tuple[Column, Column]:
    """(flag, status) of a graded essay: the last rule that holds names the flag."""
    lost = F.col(question).isNull() & F.col(fallback).isNull()
    flag = F.when(lost, "fallback_ocr_ambiguous_question").when(F.col(score) == 0, "essay_score_zero").when(F.col(confidence) < LOW_ESSAY_CONFIDENCE, "essay_low_confidence")
    return flag, F.when(lost, "needs_review").otherwise("graded")


def essay_total(scores: Column, most: Column) -> Column:
    """Clamped sum of criterion scores; a total that a model states is never trusted."""
    return S.clamp(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), 0.0, most)


def essay_confidence(values: Column) -> Column:
    """Mean of criterion confidences, 1 without any."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(1.0)


def marks(ratios: Column) -> Column:
    """Decision over array<struct<label,ratio>> fill ratios: struct(label, confidence, multiple).

    Two filled bubbles are a multiple mark of confidence 0; none filled has no label; else confidence is the lead of
    the best over the second, relative to the best. Ties go to the earlier bubble."""
    ranked = F.array_sort(F.transform(ratios, lambda x, i: F.struct((-x["ratio"]).alias("r"), i.alias("i"), x["label"].alias("label"))))
    best, second = -F.get(ranked, F.lit(0))["r"], F.coalesce(-F.get(ranked, F.lit(1))["r"], F.lit(0.0))
    filled = F.size(F.filter(ratios, lambda x: x["ratio"] >= FILLED))
    none, multiple = filled == 0, filled >= 2
    label = F.when(multiple, MULTIPLE).when(~none, F.get(ranked, F.lit(0))["label"])
    confidence = F.when(multiple | none, 0.0).otherwise(F.least(F.lit(1.0), (best - second) / best))
    return F.struct(label.alias("label"), confidence.alias("confidence"), multiple.alias("multiple"))


def mark_status(label: Column, confidence: Column) -> Column:
    return F.when(label.isNull() | (F.coalesce(confidence, F.lit(0.0)) < LOW_MARK_CONFIDENCE), "needs_review").otherwise("done")


def upsert_flags(flags: DataFrame, new: DataFrame) -> DataFrame:
    """flags with the reasons of new (submission_answer_id, flag_reason): one flag for each answer; a flag that exists
    keeps its review, and nothing takes a flag away. Of several new reasons the greatest counts."""
    one = new.groupBy("submission_answer_id").agg(F.max("flag_reason").alias("__new"))
    rest = [c for c in flags.columns if c not in ("submission_answer_id", "flag_reason")]
    return flags.join(one, "submission_answer_id", "full").select("submission_answer_id", F.coalesce("__new", "flag_reason").alias("flag_reason"), *rest)


def review_flags(flags: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flags, refused) after reviews (submission_answer_id, decision): unknown decisions are refused; an answer
    without a flag gets one of reason `verified`. One review for each answer, else the greatest decision counts."""
    known = F.col("decision").isin("confirmed_error", "false_positive", "verified")
    good = reviews.where(known).groupBy("submission_answer_id").agg(F.max("decision").alias("__d"))
    rest = [c for c in flags.columns if c not in ("submission_answer_id", "flag_reason", "review_decision")]
    out = flags.join(good, "submission_answer_id", "full").select("submission_answer_id", F.coalesce("flag_reason", F.lit("verified")).alias("flag_reason"), F.coalesce("__d", "review_decision").alias("review_decision"), *rest)
    return out, reviews.where(~F.coalesce(known, F.lit(False)))


def override(answers: DataFrame, changes: DataFrame, questions: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, outcomes) after teachers' scores (id, score, reference): under 0, NaN, or over the points of a linked
    question, is refused; with a reference text and recognised text, cer and wer follow, to four digits. Of several
    changes of an answer the last by the order column counts, without one the greatest; the last with a reference gives
    the rates. Outcomes has a row for each change."""
    q = questions.select(F.col("id").alias("question_id"), F.col("max_points").alias("__most"))
    rows = changes.join(answers.select("id", "submission_id", "question_id", "ocr_text"), "id", "left").join(q, "question_id", "left")
    bad = (F.col("score") < 0) | F.isnan("score") | F.coalesce(F.col("score") > F.col("__most"), F.lit(False))
    judged = rows.withColumn("outcome", F.when(F.col("submission_id").isNull(), "not_found").when(bad, "out_of_range").otherwise("ok"))
    compare = F.col("reference").isNotNull() & S.has_text("ocr_text")
    place = F.struct(*([order] if order else []), "score", "reference")
    last = judged.where("outcome = 'ok'").groupBy("id").agg(
        F.max_by("score", place).alias("__s"), F.max_by(F.when(compare, F.struct(S.strip("reference").alias("r"), S.strip("ocr_text").alias("o"))), F.when(compare, place)).alias("__t")
    )
    new = last.select("id", "__s", cer("__t.r", "__t.o").alias("__c"), wer("__t.r", "__t.o").alias("__w"))
    new = with_rounded(new, {"__c": 4, "__w": 4})
    cols = [c for c in answers.columns if c not in ("teacher_score", "cer", "wer")]
    out = answers.join(new, "id", "left").select(*cols, F.coalesce("__s", "teacher_score").alias("teacher_score"), F.coalesce("__c", "cer").alias("cer"), F.coalesce("__w", "wer").alias("wer"))
    return out, judged.select("id", "outcome")


def needs_model(questions: DataFrame, exams: DataFrame, templated: DataFrame | None = None) -> DataFrame:
    """(exam_id, needs_model): text recognition is needed unless the exam has a template (templated: exam_id; None: all
    have one) and all its questions are bubbles."""
    own = questions.groupBy("exam_id").agg(F.bool_or(~S.type_or_essay().isin("mcq", "tf")).alias("m"))
    rows = exams.select(F.col("id").alias("exam_id")).join(own, "exam_id", "left")
    if templated is None:
        return rows.select("exam_id", F.coalesce("m", F.lit(True)).alias("needs_model"))
    has = templated.select("exam_id").distinct().withColumn("__t", F.lit(True))
    return rows.join(has, "exam_id", "left").select("exam_id", (F.col("__t").isNull() | F.coalesce("m", F.lit(False))).alias("needs_model"))


def eligible(submissions: DataFrame, pending: DataFrame) -> DataFrame:
    """Submitted ones that don't wait in the queue (submission_id) already, each once."""
    return submissions.where("status = 'submitted'").dropDuplicates(["id"]).join(pending.select(F.col("submission_id").alias("id")), "id", "left_anti")
