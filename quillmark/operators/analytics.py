"""Roll-ups of exams, questions, classes, students and flags; each is one plan for all ids at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import scalar as S

PASS_SHARE = 0.6


def exam_max(questions: DataFrame, exams: DataFrame) -> DataFrame:
    """(exam_id, max_score, n_questions), 0 without questions."""
    own = questions.groupBy("exam_id").agg(F.sum("max_points").alias("m"), F.count("*").alias("n"))
    return exams.select(F.col("id").alias("exam_id")).join(own, "exam_id", "left").select("exam_id", F.coalesce("m", F.lit(0.0)).alias("max_score"), F.coalesce("n", F.lit(0)).alias("n_questions"))


def submission_totals(submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """(submission_id, exam_id, student_id, status, total): missing scores count 0, answers without a question count."""
    own = answers.groupBy("submission_id").agg(F.sum(S.final_score_or_zero()).alias("t"))
    subs = submissions.select(F.col("id").alias("submission_id"), "exam_id", "student_id", "status")
    return subs.join(own, "submission_id", "left").withColumn("total", F.coalesce("t", F.lit(0.0))).drop("t")


def exam_stats(exams: DataFrame, questions: DataFrame, submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """(exam_id, class_id, max_score, n_questions, n_submissions, n_graded, avg_score, avg_pct, n_pass, n_fail); averages
    over graded submissions, unrounded."""
    m = exam_max(questions, exams)
    totals = submission_totals(submissions, answers).join(m.select("exam_id", "max_score"), "exam_id")
    graded = F.col("status") == "graded"
    own = totals.groupBy("exam_id").agg(
        F.count("*").alias("n_submissions"), F.count_if(graded).alias("n_graded"), F.avg(F.when(graded, F.col("total"))).alias("avg_score"),
        F.count_if(graded & (F.col("total") >= PASS_SHARE * F.col("max_score"))).alias("n_pass"),
    )
    out = m.join(exams.select(F.col("id").alias("exam_id"), "class_id"), "exam_id").join(own, "exam_id", "left").fillna(0, ["n_submissions", "n_graded", "n_pass"])
    return out.withColumn("avg_pct", F.when(F.col("max_score") > 0, F.col("avg_score") / F.col("max_score") * 100)).withColumn("n_fail", F.col("n_graded") - F.col("n_pass"))


def question_stats(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, exam_id, order_index, n_scored, avg_score, min_score, max_score) over answers with a score, whatever
    the submission's status."""
    f = S.final_score()
    own = answers.where(f.isNotNull() & F.col("question_id").isNotNull()).groupBy("question_id").agg(F.count("*").alias("n"), F.avg(f).alias("avg_score"), F.min(f).alias("min_score"), F.max(f).alias("max_score"))
    return questions.select(F.col("id").alias("question_id"), "exam_id", "order_index").join(own, "question_id", "left").withColumn("n_scored", F.coalesce("n", F.lit(0))).drop("n")


def student_history(students: DataFrame, submissions: DataFrame, exams: DataFrame, classes: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(student_id, submission_id, class_code, exam_code, status, total, pct): scores that exist only, null without any,
    any status. Questions and answers are aggregated apart, so neither multiplies the other."""
    f = S.final_score()
    own = answers.where(f.isNotNull()).groupBy("submission_id").agg(F.sum(f).alias("total"))
    m = questions.groupBy("exam_id").agg(F.sum("max_points").alias("m"))
    e = exams.select(F.col("id").alias("exam_id"), "class_id", "exam_code").join(classes.select(F.col("id").alias("class_id"), F.col("code").alias("class_code")), "class_id", "left")
    subs = submissions.select(F.col("id").alias("submission_id"), "exam_id", F.col("student_id").alias("sid"), "status")
    st = students.select(F.col("id").alias("sid"), "student_id")
    out = st.join(subs, "sid").join(e, "exam_id", "left").join(m, "exam_id", "left").join(own, "submission_id", "left")
    return out.select("student_id", "submission_id", "class_code", "exam_code", "status", "total", F.when(F.col("m") > 0, F.col("total") / F.col("m") * 100).alias("pct"))


def class_rollup(classes: DataFrame, enrollments: DataFrame, stats: DataFrame) -> DataFrame:
    """(class_id, code, n_enrolled, n_exams, n_graded_exams, n_pass, n_fail) over exam_stats."""
    n = enrollments.groupBy("class_id").agg(F.count("*").alias("n_enrolled"))
    e = stats.groupBy("class_id").agg(F.count("*").alias("n_exams"), F.count_if(F.col("n_graded") > 0).alias("n_graded_exams"), F.sum("n_pass").alias("n_pass"), F.sum("n_fail").alias("n_fail"))
    out = classes.select(F.col("id").alias("class_id"), "code").join(n, "class_id", "left").join(e, "class_id", "left")
    return out.fillna(0, ["n_enrolled", "n_exams", "n_graded_exams", "n_pass", "n_fail"])


def class_analytics(classes: DataFrame, stats: DataFrame) -> DataFrame:
    """Classes with their exams nested, in id order."""
    nested = stats.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("exam_id", "n_graded", "avg_score", "n_pass", "n_fail"))).alias("exams"))
    return classes.select(F.col("id").alias("class_id"), "code").join(nested, "class_id", "left")


def score_rollup(stats: DataFrame) -> DataFrame:
    """Passes by class and exam, by class, and over all: one grouping-sets aggregate."""
    return stats.rollup("class_id", "exam_id").agg(F.sum("n_pass").alias("n_pass"), F.sum("n_graded").alias("n_graded"), F.grouping_id().cast("int").alias("level"))


def flag_stats(exams: DataFrame, submissions: DataFrame, answers: DataFrame, questions: DataFrame, flags: DataFrame) -> DataFrame:
    """Confusion counts of automatic flags by exam, with precision and recall (null without a denominator).

    Flags whose reason is `verified` aren't automatic, yet a decision `verified` makes a true negative whatever the
    reason. A false negative is an unflagged answer that the teacher moved by at least a tenth of its points, and at
    least half a point; answers without a question count as worth 10."""
    base = answers.where("ai_score is not null").join(submissions.select(F.col("id").alias("submission_id"), "exam_id"), "submission_id")
    rows = base.join(flags.withColumnRenamed("submission_answer_id", "id"), "id", "left").join(questions.select(F.col("id").alias("question_id"), "max_points"), "question_id", "left")
    auto = F.coalesce(F.col("flag_reason") != "verified", F.lit(False))
    decided = lambda d: F.coalesce(F.col("review_decision") == d, F.lit(False))
    moved = F.abs(F.col("teacher_score") - F.col("ai_score")) >= F.greatest(F.lit(0.5), 0.1 * F.coalesce("max_points", F.lit(10.0)))
    own = rows.groupBy("exam_id").agg(
        F.count("*").alias("n_answers"), F.count_if(auto).alias("n_flagged"), F.count_if(auto & F.col("review_decision").isNotNull()).alias("n_reviewed"),
        F.count_if(auto & decided("confirmed_error")).alias("tp"), F.count_if(auto & decided("false_positive")).alias("fp"), F.count_if(decided("verified")).alias("tn"),
        F.count_if(~auto & F.coalesce(moved, F.lit(False))).alias("fn"),
    )
    out = exams.select(F.col("id").alias("exam_id")).join(own, "exam_id", "left").fillna(0)
    return out.withColumn("precision", S.ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", S.ratio("tp", F.col("tp") + F.col("fn")))


def grade_sheet(students: DataFrame, submissions: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each submission and question of its exam, answered or not; of several answers the last counts."""
    last = answers.where("question_id is not null").groupBy("submission_id", "question_id").agg(F.max_by(F.struct("ai_score", "teacher_score"), "id").alias("a"))
    s = submissions.select(F.col("id").alias("submission_id"), "exam_id", F.col("student_id").alias("sid"), "status").join(students.select(F.col("id").alias("sid"), "student_id", "full_name"), "sid", "left")
    q = questions.select(F.col("id").alias("question_id"), "exam_id", "order_index", "question_type", "max_points")
    out = s.join(q, "exam_id").join(last, ["submission_id", "question_id"], "left")
    answered = F.col("a").isNotNull()
    return out.select(
        "exam_id", F.coalesce("student_id", F.lit("—")).alias("student_id"), "full_name", "submission_id", F.col("order_index").alias("question_order"), "question_type", "max_points",
        F.col("a.ai_score").alias("ai_score"), F.col("a.teacher_score").alias("teacher_score"), S.final_score("a.teacher_score", "a.ai_score").alias("final_score"),
        F.when(answered, F.col("status")).otherwise("not_submitted").alias("answer_status"),
    )


def result_totals(submissions: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """What the result page shows of a submission: sums, whether anything is graded or overridden, percentage."""
    own = answers.groupBy("submission_id").agg(
        F.sum(F.coalesce("ai_score", F.lit(0.0))).alias("ai_total"), F.sum(S.final_score_or_zero()).alias("final_total"),
        F.bool_or(S.final_score().isNotNull()).alias("any_graded"), F.bool_or(F.col("teacher_score").isNotNull()).alias("any_override"),
    )
    m = questions.groupBy("exam_id").agg(F.sum("max_points").alias("max_total"))
    out = submissions.select(F.col("id").alias("submission_id"), "exam_id").join(own, "submission_id").join(m, "exam_id", "left")
    return out.withColumn("pct", S.percent_of("final_total", "max_total"))


def enrolled(students: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Students of each class."""
    return enrollments.select("class_id", F.col("student_id").alias("sid")).join(students.withColumnRenamed("id", "sid"), "sid").select("class_id", "student_id", "full_name", "email")


def not_enrolled(students: DataFrame, enrollments: DataFrame, class_id: int) -> DataFrame:
    return students.join(enrollments.where(F.col("class_id") == class_id).select(F.col("student_id").alias("id")), "id", "left_anti")


def named_submissions(submissions: DataFrame, students: DataFrame) -> DataFrame:
    """Submissions with their student's names, a dash where the student is unknown."""
    s = students.select(F.col("id").alias("student_id"), F.col("student_id").alias("external_id"), "full_name")
    return submissions.join(s, "student_id", "left").select("id", "exam_id", "status", F.coalesce("external_id", F.lit("—")).alias("external_id"), F.coalesce("full_name", F.lit("—")).alias("full_name"))


def effective_questions(answers: DataFrame, submissions: DataFrame, questions: DataFrame, templated: DataFrame | None = None) -> DataFrame:
    """Answers with their question, or their exam's only gradable one (neither mcq nor tf) where they have none.
    templated: (exam_id) of the exams whose questions the bulk path looks at; all by default."""
    q = questions if templated is None else questions.join(templated, "exam_id", "left_semi")
    gradable = ~S.type_or_essay().isin("mcq", "tf")
    only = q.where(gradable).groupBy("exam_id").agg(F.count("*").alias("n"), F.min("id").alias("fallback_id")).where("n = 1").drop("n")
    rows = answers.join(submissions.select(F.col("id").alias("submission_id"), "exam_id"), "submission_id").join(only, "exam_id", "left")
    return rows.withColumn("effective_id", F.coalesce("question_id", "fallback_id")).drop("fallback_id")
