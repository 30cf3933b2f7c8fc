"""Copies, imports and changes of questions, rubrics and scores, case by case."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.functions.rounding import with_rounded
from quillmark.operators import grading as G
from quillmark.operators import mutations as M
from quillmark.operators import reports as R
from quillmark.operators.numbering import first_of, numbered, top_k


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_rounding_is_pythons(spark):
    rng = random.Random(7)
    x = [rng.random() * 10 ** rng.randint(-3, 6) for _ in range(40_000)] + [rng.randrange(10**7) / 200 for _ in range(40_000)] + [rng.randrange(2**40) / 2 ** rng.randrange(1, 30) for _ in range(40_000)]
    x += [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1023) for _ in range(40_000)] + [2.0 ** rng.uniform(30, 54) for _ in range(40_000)]
    x += [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 2.675, 1.005, 0.125, 0.35, 5e-324, 4503599627370495.5, 4503599627370497.5, 1e300, math.inf, -math.inf]
    for d in (0, 1, 2, 4, 9):
        got = with_rounded(spark.createDataFrame(pd.DataFrame({"x": x, "y": x})), {"y": d}).toPandas()
        assert all(b == (round(a, d) if math.isfinite(a) else a) for a, b in zip(got.x, got.y, strict=True)), d
    odd = spark.createDataFrame([(None, 1), (math.nan, 2)], "`a b` double, k int")
    assert [str(r[0]) for r in with_rounded(odd, {"a b": 1}).orderBy("k").collect()] == ["None", "nan"]
    with pytest.raises(ValueError, match="digits"):
        with_rounded(odd, {"a b": 16})


def test_rounding_stays_in_one_generated_stage(spark):
    plan = with_rounded(spark.range(5).select((F.col("id") / 3).alias("a"), (F.col("id") / 7).alias("b")), {"a": 2, "b": 1})._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in plan and "Python" not in plan


def test_numbers_have_no_gaps_and_no_single_task(spark):
    df = spark.range(3000).select("id", (F.xxhash64("id") % 500).alias("v"), F.when(F.col("id") % 3 > 0, 0).when(F.col("id") % 30 == 0, None).otherwise(F.col("id") % 7).alias("k"))
    out = numbered(df, ["v", "id"]).toPandas().sort_values(["v", "id"])
    assert out.number.tolist() == list(range(1, 3001)) and list(out.columns) == ["id", "v", "k", "number"]
    out = numbered(df, ["v", "id"], ["k"], "n", 5).toPandas().sort_values(["v", "id"])
    assert all(g.n.tolist() == list(range(5, 5 + len(g))) for _, g in out.groupby("k", dropna=False)) and out.n.max() == 4 + (out.k == 0).sum()
    assert numbered(df.limit(0), ["id"]).count() == 0
    plan = numbered(df, ["v", "id"], ["k"])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_first_and_top_rows_say_where_nulls_go(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 2.0, 2), (1, 2.0, 3), (2, None, 4), (3, 1.0, 5), (3, None, 6)], "k int, v double, id int")
    down = [F.col("v").desc_nulls_last(), F.col("id")]
    assert sorted(rows(first_of(df, ["k"], down), "k", "id")) == [(1, 2), (2, 4), (3, 5)]
    assert sorted(rows(first_of(df, ["k"], [F.col("v").asc_nulls_first(), F.col("id")]), "k", "id")) == [(1, 1), (2, 4), (3, 6)]
    assert rows(top_k(df, 3, down).orderBy("place"), "id", "place") == [(2, 1), (3, 2), (5, 3)] and top_k(df.limit(0), 3, down).count() == 0


def test_copies_keep_title_and_description_and_lose_regions(spark):
    exams = spark.createDataFrame([(1, 7, "A", "Midterm", "all of it", "{}"), (5, 7, "B", "Final", None, None)], "id long, class_id int, exam_code string, title string, description string, template_spec_json string")
    questions = spark.createDataFrame([(3, 1, 2, "second", "{}"), (9, 1, 1, "first", "{}")], "id long, exam_id long, order_index int, prompt string, region_json string")
    e, q = M.duplicate_exams(exams, questions, spark.createDataFrame([("A", "A_copy"), ("B", "B_copy")], "code string, clone string"))
    assert rows(e.where("id > 5").orderBy("id")) == [(6, 7, "A_copy", "Midterm (copy)", "all of it", None), (7, 7, "B_copy", "Final (copy)", None, None)]
    assert rows(q.where("id > 9").orderBy("id")) == [(10, 6, 1, "first", None), (11, 6, 2, "second", None)] and q.count() == 4
    assert M.duplicate_exams(exams.limit(0), questions.limit(0), spark.createDataFrame([], "code string, clone string"))[0].count() == 0


def test_rubrics_of_repeated_order_numbers_go_to_the_last_question(spark):
    questions = spark.createDataFrame([(1, 1, 1, "old"), (2, 1, 1, "old")], "id int, exam_id int, order_index int, rubric_text string")
    new = spark.createDataFrame([(1, 2, "1", "a"), (1, 3, " 1", " b "), (1, 4, "1.0", "c"), (1, 5, None, "d"), (2, 2, "1", "e")], "exam_id int, row int, order_index string, rubric_text string")
    done, outcomes = M.import_rubrics(questions, new)
    assert sorted(rows(done, "id", "rubric_text")) == [(1, "old"), (2, "b")] and outcomes.count() == 5 and outcomes.where("error is null").count() == 2


def test_overrides_leave_one_row_for_each_answer(spark):
    answers = spark.createDataFrame([(1, 10, 5, "the cat", 2.0, None, None), (2, 10, None, None, None, 0.5, 0.5)], "id int, submission_id int, question_id int, ocr_text string, teacher_score double, cer double, wer double")
    questions = spark.createDataFrame([(5, 10.0)], "id int, max_points double")
    changes = [(1, 4.0, " the hat ", 1), (1, 3.0, None, 2), (1, 11.0, None, 3), (2, 99.0, "x", 1), (2, math.nan, None, 2), (3, 1.0, None, 1)]
    out, outcomes = G.override(answers, spark.createDataFrame(changes, "id int, score double, reference string, at int"), questions, "at")
    assert sorted(rows(out, "id", "teacher_score", "cer", "wer")) == [(1, 3.0, 0.1429, 0.5), (2, 99.0, 0.5, 0.5)]
    assert sorted(rows(outcomes)) == [(1, "ok"), (1, "ok"), (1, "out_of_range"), (2, "ok"), (2, "out_of_range"), (3, "not_found")]
    assert dict(rows(G.override(answers, spark.createDataFrame(changes, "id int, score double, reference string, at int"), questions)[0], "id", "teacher_score")) == {1: 4.0, 2: 99.0}


def test_question_changes(spark):
    q = [(1, 1, 1, "p", "essay", "r", None, 10.0, None, None, "{}"), (2, 1, 2, "p", "mcq", None, None, 5.0, '["a"]', "a", "{}")]
    q = spark.createDataFrame(q, "id int, exam_id int, order_index int, prompt string, question_type string, rubric_text string, rubric_criteria_json string, max_points double, choices_json string, correct_answer string, region_json string")
    columns = "id int, prompt string, question_type string, rubric_text string, rubric_criteria_json string, max_points double, choices_json string, correct_answer string, order_index int"

    def after(*change):
        out, told = M.update_questions(q, spark.createDataFrame([change], columns))
        return next((r for r in out.collect() if r.id == change[0]), None), told.first()

    new, told = after(1, " new ", None, " ", '[{"name":"A","levels":[{"label":"x","points":3},{"label":"y","points":1.5}]},{"name":"B","levels":null}]', 99.0, None, None, 7)
    assert (new.prompt, new.rubric_text, new.max_points, new.order_index, new.region_json) == ("new", None, 3.0, 7, None) and '"max_points":3.0' in new.rubric_criteria_json and told.structural
    assert after(1, None, None, None, "{bad", None, None, None, None)[1].outcome == "bad_criteria" and after(9, None, None, None, None, 1.0, None, None, None)[1].outcome == "not_found"
    assert after(2, None, None, None, None, None, None, " ", None)[1].outcome == "no_answer" and after(1, None, "tf", None, None, None, None, None, None)[1].outcome == "no_answer"
    new, told = after(2, None, "mcq", None, None, 5.0, '["a"]', " b ", None)  # nothing structural changes
    assert (told.outcome, told.structural, new.correct_answer, new.region_json) == ("ok", False, "b", "{}")
    new, told = after(2, None, None, None, None, 6.0, None, None, None)
    assert told.structural and (new.max_points, new.region_json) == (6.0, None)


def test_sheet_of_unknown_students_and_unanswered_questions(spark):
    students = spark.createDataFrame([(1, "s1", None)], "id int, student_id string, full_name string")
    submissions = spark.createDataFrame([(10, 1, 1), (11, 1, 77)], "id int, exam_id int, student_id int")
    questions = spark.createDataFrame([(5, 1, 1, "x" * 200, "essay", 10.0), (6, 1, 2, None, "tf", 1.0)], "id int, exam_id int, order_index int, prompt string, question_type string, max_points double")
    answers = [(1, 10, 5, 1.0, None, 0.5, None, None, None, "graded"), (2, 10, 5, None, None, None, None, None, None, "needs_review"), (3, 11, None, 9.0, None, None, None, None, None, "graded")]
    answers = spark.createDataFrame(answers, "id int, submission_id int, question_id int, ai_score double, teacher_score double, groq_confidence double, omr_confidence double, cer double, wer double, status string")
    got = rows(R.grade_sheet(students, submissions, questions, answers).orderBy("submission_id", "question_order"), "student_id", "student_name", "question_prompt", "ai_score", "final_score", "status")
    assert got == [("s1", None, "x" * 80, None, None, "needs_review"), ("s1", None, None, None, None, "not_submitted"), ("77", "Unknown", "x" * 80, None, None, "not_submitted"), ("77", "Unknown", None, None, None, "not_submitted")]


def test_sheets_are_made_of_submissions_where_these_lie(spark, tmp_path):
    from quillmark.operators import reports as R
    from quillmark.plans.views import Model
    from quillmark.sources import files

    m = Model(spark, "/root/testdata/sf0.001")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(m.full("answers")) == joins(m.answers)  # an answer's details come from its own row
    questions = m.full("questions")
    m = Model(spark, m.dir)
    m.deal("lineitem", "l_orderkey")
    own = R.sheet_submissions(m.students, m.submissions, m.full("answers"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        plan = own.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("l_orderkey" in line for line in moved) == 1 and not any("l_linenumber" in line or "question_id" in line for line in moved)
    whole = R.sheet_rows(own, questions)
    folder = str(tmp_path / "sheets")
    for _ in range(2):
        files.write_sheets(own, folder, lambda rows: R.sheet_rows(rows, questions), 5)
    back = files.read_csv(spark, folder, files.GRADE_SHEET[:1])
    key = lambda df: sorted((r.exam_id, r.student_id, int(r.question_order), r.status, r.final_score) for r in df.collect())
    want = whole.selectExpr("cast(exam_id as string) as exam_id", "student_id", "question_order", "status", "coalesce(cast(final_score as string), '') as final_score")
    assert key(back) == key(want) and back.count() > 100
    for f in (tmp_path / "sheets").rglob("*.csv"):
        at = [(line.split(",")[0], int(line.split(",")[2])) for line in f.read_text().splitlines()[1:]]
        assert at == sorted(at)
