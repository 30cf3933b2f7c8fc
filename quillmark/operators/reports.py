"""Reports as they are served: rounded figures, prompts cut to size, and explicit orders.

Figures are those of `analytics`, rounded once at the end (`functions.rounding`); a percentage of a rounded total is
taken from the rounded total. Every order ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import scalar as S
from quillmark.functions.rounding import with_rounded
from quillmark.operators import analytics as A

# Lengths of prompts in reports and sheets; what stands for an unknown exam or class, and student.
REPORT_PROMPT, SHEET_PROMPT, UNKNOWN, UNKNOWN_NAME = 120, 80, "—", "Unknown"


def exam_report(exams: DataFrame, questions: DataFrame, submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """(exam_id, class_id, exam_code, title, created_at, submission_count, graded_count, max_possible, avg_total, avg_pct,
    pass_count, fail_count): averages of graded submissions to two digits, their percentage, from the unrounded average,
    to one."""
    s = A.exam_stats(exams, questions, submissions, answers)
    e = exams.select(F.col("id").alias("exam_id"), "exam_code", "title", "created_at")
    out = s.join(e, "exam_id").select(
        "exam_id", "class_id", "exam_code", "title", "created_at", F.col("n_submissions").alias("submission_count"), F.col("n_graded").alias("graded_count"), F.col("max_score").alias("max_possible"),
        F.col("avg_score").alias("avg_total"), "avg_pct", F.col("n_pass").alias("pass_count"), F.col("n_fail").alias("fail_count"),
    )
    return with_rounded(out, {"avg_total": 2, "avg_pct": 1})


def question_report(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(exam_id, place, question_id, order_index, prompt, max_points, avg_score, min_score, max_score, answer_count):
    scores to two digits; place is the question's in its exam, by order_index, then id."""
    s = A.question_stats(questions, answers).drop("exam_id", "order_index")
    q = questions.select(F.col("id").alias("question_id"), "exam_id", "order_index", F.substring("prompt", 1, REPORT_PROMPT).alias("prompt"), "max_points")
    place = F.row_number().over(Window.partitionBy("exam_id").orderBy(F.col("order_index").asc_nulls_first(), "question_id"))
    out = q.join(s, "question_id").select("exam_id", place.alias("place"), "question_id", "order_index", "prompt", "max_points", "avg_score", "min_score", "max_score", F.col("n_scored").alias("answer_count"))
    return with_rounded(out, dict.fromkeys(("avg_score", "min_score", "max_score"), 2))


def class_report(classes: DataFrame, enrollments: DataFrame, exams: DataFrame, questions: DataFrame) -> DataFrame:
    """(class_id, class_code, class_name, student_count, exams) from the reports of exams and questions: exams in order of
    created_at, then id, each with its questions in order. A class without exams has an empty list."""
    q = questions.groupBy("exam_id").agg(F.sort_array(F.collect_list(F.struct("place", *[c for c in questions.columns if c not in ("exam_id", "place")]))).alias("questions"))
    e = exams.join(q, "exam_id", "left").withColumn("questions", F.coalesce("questions", F.array().cast(q.schema["questions"].dataType)))
    e = e.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("created_at", *[c for c in e.columns if c not in ("class_id", "created_at")]))).alias("exams"))
    n = enrollments.groupBy("class_id").agg(F.count("*").alias("student_count"))
    out = classes.select(F.col("id").alias("class_id"), F.col("code").alias("class_code"), F.col("name").alias("class_name")).join(n, "class_id", "left").join(e, "class_id", "left")
    return out.select("class_id", "class_code", "class_name", F.coalesce("student_count", F.lit(0)).alias("student_count"), F.coalesce("exams", F.array().cast(e.schema["exams"].dataType)).alias("exams"))


def student_report(students: DataFrame, submissions: DataFrame, exams: DataFrame, classes: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(student_id, place, submission_id, exam_id, exam_code, exam_title, class_code, status, total_score, max_possible,
    pct): a student's submissions by created_at, then id; total to two digits and percentage, from that total, to one;
    null without a score. A dash where the exam or class is unknown."""
    h = A.student_history(students, submissions, exams.withColumn("exam_code", F.struct("exam_code", "title")), classes, questions, answers)
    m = questions.groupBy("exam_id").agg(F.sum("max_points").alias("m"))
    s = submissions.select(F.col("id").alias("submission_id"), "exam_id", "created_at")
    rows = h.join(s, "submission_id").join(m, "exam_id", "left").withColumn("max_possible", F.coalesce("m", F.lit(0.0)))
    rows = with_rounded(rows.withColumnRenamed("total", "total_score").drop("pct"), {"total_score": 2})
    place = F.row_number().over(Window.partitionBy("student_id").orderBy(F.col("created_at").asc_nulls_first(), "submission_id"))
    out = rows.select(
        "student_id", place.alias("place"), "submission_id", "exam_id", F.coalesce("exam_code.exam_code", F.lit(UNKNOWN)).alias("exam_code"), F.coalesce("exam_code.title", F.lit(UNKNOWN)).alias("exam_title"),
        F.coalesce("class_code", F.lit(UNKNOWN)).alias("class_code"), "status", "total_score", "max_possible", F.when(F.col("max_possible") > 0, F.col("total_score") / F.col("max_possible") * 100).alias("pct"),
    )
    return with_rounded(out, {"pct": 1})


def flag_report(exams: DataFrame, stats: DataFrame) -> DataFrame:
    """flag_stats with the exam's code, precision and recall to four digits."""
    e = exams.select(F.col("id").alias("exam_id"), "exam_code")
    return with_rounded(stats.join(e, "exam_id"), {"precision": 4, "recall": 4})


CELLS = ("ai_score", "teacher_score", "groq_confidence", "omr_confidence", "cer", "wer", "status")


def grade_sheet(students: DataFrame, submissions: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """The exported sheet: a row for each submission and question of its exam, answered or not, with exam_id, submission_id
    and question_id before the sheet's columns. Of several answers the last counts; an unknown student is named by its
    key; the status is the answer's."""
    return sheet_rows(sheet_submissions(students, submissions, answers), questions)


def sheet_submissions(students: DataFrame, submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """What the sheet is made of, a row for each submission: (exam_id, submission_id, student_id, student_name, answers),
    the last answer to each question in a list. Answers meet by submission_id alone, so those that lie by it don't move."""
    last = answers.where("question_id is not null").groupBy("submission_id", "question_id").agg(F.max_by(F.struct(*CELLS), "id").alias("a"))
    last = last.groupBy("submission_id").agg(F.collect_list(F.struct("question_id", "a.*")).alias("answers"))
    s = submissions.select(F.col("id").alias("submission_id"), "exam_id", F.col("student_id").alias("sid")).join(students.select(F.col("id").alias("sid"), "student_id", "full_name"), "sid", "left")
    known = F.col("student_id").isNotNull()
    return s.join(last, "submission_id", "left").select(
        "exam_id", "submission_id", F.coalesce("student_id", F.col("sid").cast("string")).alias("student_id"), F.when(known, F.col("full_name")).otherwise(UNKNOWN_NAME).alias("student_name"), "answers",
    )


def sheet_rows(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """The sheet's rows from those of sheet_submissions(), where these lie: the questions, a few for each exam, are sent
    to all tasks."""
    q = questions.select(F.col("id").alias("question_id"), "exam_id", "order_index", F.substring("prompt", 1, SHEET_PROMPT).alias("question_prompt"), "question_type", "max_points")
    out = rows.join(F.broadcast(q), "exam_id").withColumn("a", F.get(F.filter("answers", lambda x: x["question_id"] == F.col("question_id")), F.lit(0)))
    return out.select(
        "exam_id", "submission_id", "question_id", "student_id", "student_name",
        F.col("order_index").alias("question_order"), "question_prompt", "question_type", "max_points", *[F.col(f"a.{c}").alias(c) for c in CELLS[:2]], S.final_score("a.teacher_score", "a.ai_score").alias("final_score"),
        *[F.col(f"a.{c}").alias(c) for c in CELLS[2:-1]], F.when(F.col("a").isNull(), "not_submitted").otherwise(F.col("a.status")).alias("status"),
    )
