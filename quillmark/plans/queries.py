"""Queries over the exam model, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import scalar as S
from quillmark.functions.python_parity import match_ratio
from quillmark.operators import analytics as A
from quillmark.operators import grading as G
from quillmark.operators import layout as L
from quillmark.operators import mutations as M
from quillmark.operators import paper as P
from quillmark.operators import text as T
from quillmark.plans.views import Model, with_views
from quillmark.streaming import queue as W

_QUERIES: dict[str, Callable[[Model], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, also: str = ""):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(sql, also)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f: f(Model(spark, sf_dir))) for n, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


FINAL = "coalesce(teacher_score, ai_score)"
_TOTALS = f"""totals as (select s.id as submission_id, s.exam_id, s.student_id, s.status, coalesce(sum(coalesce(teacher_score, ai_score, 0)), 0) as total
  from submissions s left join submission_answers a on a.submission_id = s.id group by all),
maxes as (select e.id as exam_id, e.class_id, coalesce(sum(q.max_points), 0) as max_score, count(q.id) as n_questions from exams e left join exam_questions q on q.exam_id = e.id group by all),
stats as (select m.exam_id, m.class_id, max_score, n_questions, count(t.submission_id) as n_submissions, count(*) filter (status = 'graded') as n_graded,
  avg(total) filter (status = 'graded') as avg_score, count(*) filter (status = 'graded' and total >= 0.6 * max_score) as n_pass
  from maxes m left join totals t on t.exam_id = m.exam_id group by all),
exam_stats as (select *, case when max_score > 0 then avg_score / max_score * 100 end as avg_pct, n_graded - n_pass as n_fail from stats)"""


def _stats(m: Model) -> DataFrame:
    return A.exam_stats(m.exams, m.exam_questions, m.submissions, m.answers)


@query("select * from submission_answers")
def scan_answers(m):
    return m.answers


@query("select id, student_id, full_name from students where id = 42")
def point_lookup(m):
    return m.students.where("id = 42").select("id", "student_id", "full_name")


@query("select * from maxes", _TOTALS)
def exam_max(m):
    return A.exam_max(m.exam_questions, m.exams).join(m.exams.select(F.col("id").alias("exam_id"), "class_id"), "exam_id")


@query("select * from totals", _TOTALS)
def submission_totals(m):
    return A.submission_totals(m.submissions, m.answers)


@query("select * from exam_stats", _TOTALS)
def exam_stats(m):
    return _stats(m)


@query(f"""select q.id as question_id, q.exam_id, q.order_index, count({FINAL}) as n_scored, avg({FINAL}) as avg_score, min({FINAL}) as min_score, max({FINAL}) as max_score
  from exam_questions q left join submission_answers a on a.question_id = q.id group by all""")
def question_stats(m):
    return A.question_stats(m.exam_questions, m.answers)


@query(f"""select st.student_id, s.id as submission_id, c.code as class_code, e.exam_code, s.status, t.total, case when q.m > 0 then t.total / q.m * 100 end as pct
  from students st join submissions s on s.student_id = st.id left join exams e on e.id = s.exam_id left join course_classes c on c.id = e.class_id
  left join (select exam_id, sum(max_points) as m from exam_questions group by 1) q on q.exam_id = s.exam_id
  left join (select submission_id, sum({FINAL}) as total from submission_answers where {FINAL} is not null group by 1) t on t.submission_id = s.id""")
def student_history(m):
    return A.student_history(m.students, m.submissions, m.exams, m.course_classes, m.exam_questions, m.answers)


@query("""select c.id as class_id, c.code, coalesce(n.n, 0) as n_enrolled, coalesce(e.n_exams, 0) as n_exams, coalesce(e.g, 0) as n_graded_exams, coalesce(e.n_pass, 0) as n_pass, coalesce(e.n_fail, 0) as n_fail
  from course_classes c left join (select class_id, count(*) as n from enrollments group by 1) n on n.class_id = c.id
  left join (select class_id, count(*) as n_exams, count(*) filter (n_graded > 0) as g, cast(sum(n_pass) as bigint) as n_pass, cast(sum(n_fail) as bigint) as n_fail from exam_stats group by 1) e on e.class_id = c.id""", _TOTALS)
def class_rollup(m):
    return A.class_rollup(m.course_classes, m.enrollments, _stats(m))


@query("select class_id, exam_id, cast(sum(n_pass) as bigint) as n_pass, cast(sum(n_graded) as bigint) as n_graded, cast(grouping_id(class_id, exam_id) as int) as level from exam_stats group by rollup (class_id, exam_id)", _TOTALS)
def score_rollup(m):
    return A.score_rollup(_stats(m))


@query("""select exam_id, n_answers, n_flagged, n_reviewed, tp, fp, tn, fn, case when tp + fp > 0 then tp / (tp + fp) end as precision, case when tp + fn > 0 then tp / (tp + fn) end as recall
  from (select e.id as exam_id, count(a.id) as n_answers, count(*) filter (auto) as n_flagged, count(*) filter (auto and review_decision is not null) as n_reviewed,
    count(*) filter (auto and review_decision = 'confirmed_error') as tp, count(*) filter (auto and review_decision = 'false_positive') as fp, count(*) filter (review_decision = 'verified') as tn,
    count(*) filter (a.id is not null and not auto and abs(teacher_score - ai_score) >= greatest(0.5, 0.1 * coalesce(max_points, 10))) as fn
    from exams e left join (select a.*, s.exam_id, f.review_decision, coalesce(f.flag_reason <> 'verified', false) as auto, q.max_points from submission_answers a
      join submissions s on s.id = a.submission_id left join flag_log f on f.submission_answer_id = a.id left join exam_questions q on q.id = a.question_id where a.ai_score is not null) a on a.exam_id = e.id group by 1)""")
def flag_stats(m):
    return A.flag_stats(m.exams, m.submissions, m.answers, m.exam_questions, m.flag_log)


@query(f"""select s.exam_id, coalesce(st.student_id, '—') as student_id, st.full_name, s.id as submission_id, q.order_index as question_order, q.question_type, q.max_points,
  a.ai_score, a.teacher_score, {FINAL} as final_score, case when a.question_id is null then 'not_submitted' else s.status end as answer_status
  from submissions s join exam_questions q on q.exam_id = s.exam_id left join students st on st.id = s.student_id
  left join (select submission_id, question_id, arg_max_null(ai_score, id) as ai_score, arg_max_null(teacher_score, id) as teacher_score from submission_answers where question_id is not null group by 1, 2) a
    on a.submission_id = s.id and a.question_id = q.id""")
def grade_sheet(m):
    return A.grade_sheet(m.students, m.submissions, m.exam_questions, m.answers)


@query("""select s.id as submission_id, s.exam_id, ai_total, final_total, any_graded, any_override, m as max_total, case when m > 0 then least(100, final_total / m * 100) else 0 end as pct
  from submissions s join (select submission_id, sum(coalesce(ai_score, 0)) as ai_total, sum(coalesce(teacher_score, ai_score, 0)) as final_total,
    bool_or(coalesce(teacher_score, ai_score) is not null) as any_graded, bool_or(teacher_score is not null) as any_override from submission_answers group by 1) a on a.submission_id = s.id
  left join (select exam_id, sum(max_points) as m from exam_questions group by 1) q on q.exam_id = s.exam_id""")
def result_totals(m):
    return A.result_totals(m.submissions, m.exam_questions, m.answers)


@query("select e.class_id, s.student_id, s.full_name, s.email from enrollments e join students s on s.id = e.student_id")
def enrolled_students(m):
    return A.enrolled(m.students, m.enrollments)


@query("select * from students where id not in (select student_id from enrollments where class_id = 3)")
def not_enrolled_students(m):
    return A.not_enrolled(m.students, m.enrollments, 3)


@query("""select s.id, s.exam_id, s.status, coalesce(t.student_id, '—') as external_id, coalesce(t.full_name, '—') as full_name
  from submissions s left join (select * from students where id % 7 <> 0) t on t.id = s.student_id""")
def named_submissions(m):
    return A.named_submissions(m.submissions, m.students.where("id % 7 <> 0"))


_EFFECTIVE = """gradable as (select exam_id, min(id) as fallback_id from exam_questions where question_type not in ('mcq', 'tf') group by 1 having count(*) = 1)"""


@query("select a.id, s.exam_id, a.question_id, coalesce(a.question_id, g.fallback_id) as effective_id from submission_answers a join submissions s on s.id = a.submission_id left join gradable g on g.exam_id = s.exam_id", _EFFECTIVE)
def effective_questions(m):
    return A.effective_questions(m.answers, m.submissions, m.exam_questions).select("id", "exam_id", "question_id", "effective_id")


@query("select a.id, s.exam_id, coalesce(a.question_id, g.fallback_id) as effective_id from submission_answers a join submissions s on s.id = a.submission_id left join (select * from gradable where exam_id % 2 = 0) g on g.exam_id = s.exam_id", _EFFECTIVE)
def effective_questions_bulk(m):
    templated = m.exams.where("id % 2 = 0").select(F.col("id").alias("exam_id"))
    return A.effective_questions(m.answers, m.submissions, m.exam_questions, templated).select("id", "exam_id", "effective_id")


@query("select a.id, a.submission_id from submission_answers a where not exists (select 1 from flag_log f where f.submission_answer_id = a.id)")
def unflagged_answers(m):
    return m.answers.join(m.flag_log.select(F.col("submission_answer_id").alias("id")), "id", "left_anti").select("id", "submission_id")


@query("select * from flag_log where submission_answer_id in (select id from submission_answers where ai_score is not null)")
def flags_of_scored(m):
    return m.flag_log.join(m.answers.where("ai_score is not null").select(F.col("id").alias("submission_answer_id")), "submission_answer_id", "left_semi")


@query("""select id, coalesce(teacher_score, ai_score) as final, coalesce(teacher_score, ai_score, 0) as final0, case when coalesce(teacher_score, ai_score, 0) >= 40 then 'good' when coalesce(teacher_score, ai_score, 0) >= 20 then 'fair' else 'poor' end as band,
  cast(floor(disc * 1000 + 0.5) as bigint) as permille, case when ai_score is not null then greatest(1, least(30, ai_score)) end as clamped from submission_answers""")
def score_expressions(m):
    f = S.final_score_or_zero()
    return m.answers.select("id", S.final_score().alias("final"), f.alias("final0"), S.band(f, [(40, "good"), (20, "fair")], "poor").alias("band"), S.half_up(F.col("disc") * 1000).alias("permille"), S.clamp("ai_score", 1.0, 30.0).alias("clamped"))


@query("select id, status, coalesce(list_position(['draft', 'submitted', 'ocr_done', 'graded'], status), 0) - 1 as step, cast(floor(exam_id * 25.0e0 * 200 / 25.4e0 + 0.5e0) as int) as px, chr(cast(65 + exam_id % 26 as int)) as letter from submissions")
def status_and_units(m):
    return m.submissions.select("id", "status", S.step_of("status").alias("step"), F.floor(F.col("exam_id") * 25.0 * 200 / 25.4 + 0.5).cast("int").alias("px"), S.letter(F.col("exam_id") % 26).alias("letter"))


@query("select * from students where contains(lower(student_id), '00001') or contains(lower(full_name), 'r#000000011')")
def search_students(m):
    return m.students.where(S.found_in("00001", "student_id") | S.found_in("R#000000011", "full_name"))


@query("select count(*) filter (status = 'submitted') as pending, count(*) filter (status = 'graded') as graded, count(*) as total, cast(floor(count(*) filter (status = 'graded') * 100 / count(*) + 0.5) as bigint) as progress from submissions")
def queue_counters(m):
    graded = F.count_if(F.col("status") == "graded")
    return m.submissions.agg(F.count_if(F.col("status") == "submitted").alias("pending"), graded.alias("graded"), F.count("*").alias("total"), S.half_up(graded * 100 / F.count("*")).alias("progress"))


# A text from which characters were left out lies exactly as many edits away, so SQL needs no table of edits here.
_PAIRS = "bent as (select doc_id, text as ref, replace(text, 'e', '') as hyp from documents)"


def _pairs(m: Model) -> DataFrame:
    return m.documents.select("doc_id", F.col("text").alias("ref"), F.replace("text", F.lit("e"), F.lit("")).alias("hyp"))


@query("select doc_id, case when length(ref) = 0 then 0 else (length(ref) - length(hyp)) / length(ref) end as cer from bent", _PAIRS)
def character_error_rate(m):
    return T.transcription_quality(_pairs(m)).select("doc_id", "cer")


@query()
def word_error_rate(m):
    return T.transcription_quality(_pairs(m)).select("doc_id", "wer")


@query("select doc_id, lower(hyp) like '%let me%' or lower(hyp) like '%does not match%' or length(concat(hyp, hyp, hyp, hyp)) > greatest(200, 3 * length(ref)) as runaway from bent", _PAIRS)
def runaway_corrections(m):
    return _pairs(m).select("doc_id", T.is_runaway("ref", F.concat("hyp", "hyp", "hyp", "hyp")).alias("runaway"))


_OBJ = """obj as (select a.id, a.sk, q.max_points, case a.sk % 5 when 0 then 'A' when 1 then ' b ' when 2 then 'B x' when 3 then 'xB' else 'Multiple bubbles marked' end as ocr_text,
  case a.sk % 3 when 0 then 'B' else 'a' end as correct_answer, a.disc * 5 as omr_confidence from submission_answers a join exam_questions q on q.id = a.question_id where q.question_type in ('mcq', 'tf'))"""


def _objective(m: Model) -> DataFrame:
    q = m.exam_questions.where("question_type in ('mcq', 'tf')").select(F.col("id").alias("question_id"), "max_points")
    return m.answers.join(q, "question_id").select(
        "id", "max_points", F.expr("case sk % 5 when 0 then 'A' when 1 then ' b ' when 2 then 'B x' when 3 then 'xB' else 'Multiple bubbles marked' end").alias("ocr_text"),
        F.expr("case sk % 3 when 0 then 'B' else 'a' end").alias("correct_answer"), (F.col("disc") * 5).alias("omr_confidence"),
    )


@query("""select id, case when ocr_text = 'Multiple bubbles marked' then 0 when upper(trim(ocr_text)) = upper(correct_answer) or upper(split_part(trim(ocr_text), ' ', 1)) = upper(correct_answer) then max_points else 0 end as score,
  case when ocr_text = 'Multiple bubbles marked' or omr_confidence < 0.3 then 'needs_review' else 'graded' end as new_status,
  case when ocr_text = 'Multiple bubbles marked' then 'omr_multiple_marks' when omr_confidence < 0.3 then 'omr_low_confidence' end as flag from obj""", _OBJ)
def objective_scores(m):
    return G.score_objective(_objective(m)).select("id", "score", "new_status", "flag")


_IDENT = """ident as (select a.id, q.max_points, concat('Answer ', a.sk) as correct_answer, length(concat('Answer ', a.sk)) as n, a.sk % 4 as kind,
  case a.sk % 4 when 0 then concat(' answer ', a.sk) when 1 then concat('nswer ', a.sk) when 2 then concat('An swer ', a.sk) else '#' end as ocr_text from submission_answers a join exam_questions q on q.id = a.question_id where q.question_type = 'identification'),
judged as (select *, case kind when 0 then 1.0e0 when 1 then 2.0e0 * (n - 1) / (2 * n - 1) when 2 then 2.0e0 * n / (2 * n + 1) else 0.0e0 end as ratio from ident)"""


def _identification(m: Model) -> DataFrame:
    rows = m.answers.join(m.exam_questions.where("question_type = 'identification'").select(F.col("id").alias("question_id"), "max_points"), "question_id")
    given = F.expr("case sk % 4 when 0 then concat(' answer ', sk) when 1 then concat('nswer ', sk) when 2 then concat('An swer ', sk) else '#' end")
    return G.score_identification(rows.select("id", "max_points", F.concat(F.lit("Answer "), F.col("sk").cast("string")).alias("correct_answer"), given.alias("ocr_text")))


@query("""select id, ratio, case when ratio >= 0.85 then max_points when ratio >= 0.6 then max_points * 0.5e0 else 0 end as score,
  case when kind = 0 then 'exact' when ratio >= 0.85 then 'close' when ratio >= 0.6 then 'partial' else 'none' end as verdict, case when ratio < 0.6 then 'identification_no_match' end as flag from judged""", _IDENT)
def identification_scores(m):
    return _identification(m).select("id", "ratio", "score", "verdict", "flag")


@query("""select id, concat('Expected: ', correct_answer, '. Your answer: ', trim(ocr_text), '. ', case when kind = 0 then 'Exact match.' else concat(case when ratio >= 0.85 then 'Accepted' when ratio >= 0.6 then 'Partial credit' else 'Incorrect' end, ' (fuzzy match ', cast(round_even(ratio * 100, 0) as bigint), '%).') end) as feedback,
  correct_answer as expected, trim(ocr_text) as given, case when kind <> 0 then cast(round_even(ratio * 100, 0) as bigint) end as percent, case when kind = 0 then 'exact' when ratio >= 0.85 then 'accepted' when ratio >= 0.6 then 'partial' else 'incorrect' end as kind from judged""", _IDENT)
def identification_feedback(m):
    rows = _identification(m).select("id", G.identification_feedback().alias("feedback"))
    return rows.select("id", "feedback", G.parse_identification().alias("p")).select("id", "feedback", "p.*")


@query("""select id, case when ocr_text = 'Multiple bubbles marked' then concat('Correct answer: ', correct_answer, '. Detected answer: multiple bubbles marked. Incorrect — more than one option was filled in, so no single answer can be credited. ⚠ Please verify on the original scan.')
  else concat('Correct answer: ', correct_answer, '. Detected answer: ', trim(ocr_text), '. ', case when upper(trim(ocr_text)) = upper(correct_answer) or upper(split_part(trim(ocr_text), ' ', 1)) = upper(correct_answer) then 'Correct.' else 'Incorrect.' end,
    case when omr_confidence < 0.3 then concat(' ⚠ Low OMR confidence (', cast(round_even(omr_confidence * 100, 0) as bigint), '%) — please verify on the original scan.') else '' end) end as feedback from obj""", _OBJ)
def objective_feedback(m):
    return _objective(m).select("id", G.objective_feedback().alias("feedback"))


@query("select id, case when upper(trim(ocr_text)) = upper(correct_answer) then max_points else 0 end as score from obj", _OBJ)
def bubble_overrides(m):
    return _objective(m).select("id", G.bubble_override("ocr_text").alias("score"))


@query("""select id, case when sk % 9 = 0 then 'error' else 'graded' end as status, case when sk % 9 = 0 then concat('[Grading error: code ', sk, ']') else 'fine' end as feedback,
  case when bool_or(sk % 9 = 0) over (partition by submission_id) then 'failed' else 'graded' end as bulk_status from submission_answers""")
def essay_failures(m):
    rows = m.answers.select("id", "submission_id", "sk", F.lit("graded").alias("status"), F.lit("fine").alias("feedback"))
    failed = rows.where("sk % 9 = 0").select("id", F.concat(F.lit("code "), F.col("sk").cast("string")).alias("message"))
    whole = G.essay_failure(rows, failed, each=False).select("id", F.col("status").alias("bulk_status"))
    return G.essay_failure(rows, failed).select("id", "status", "feedback").join(whole, "id")


_STRUCTURED = """st as (select p_partkey as id, p_partkey % 5 as kind, cast(least(10, p_size % 13) as double) as c, cast(least(5, p_size % 7) as double) as s from part),
sc as (select *, case kind when 0 then c when 2 then 3 when 4 then 4 else 0 end as content, case kind when 0 then s else 0 end as style from st)"""


@query("""select id, cast(content + style as double) as total, case kind when 0 then 0.75e0 when 3 then 0.0e0 else 0.5e0 end as confidence,
  concat('Content: ', cast(content as int), '/10 (', case when content >= 6 then 'high' else 'low' end, ') — ', case kind when 0 then 'good' when 3 then '(no response for this criterion — review manually)' else '(no justification provided)' end,
    '; Style: ', cast(style as int), '/5 — ', case kind when 0 then 'ok' else '(no response for this criterion — review manually)' end) as feedback from sc""", _STRUCTURED)
def structured_grades(m):
    raw = F.expr("""case p_partkey % 5 when 0 then concat('```json\n[{"criterion": "style ", "score": ', p_size % 7, ', "confidence": 0.5, "justification": " ok"}, {"criterion": "Content", "score": ', p_size % 13, ', "justification": "good"}]\n```')
        when 1 then 'Well: {"criterion": "Content", "score": "x"} is all' when 2 then '[{"criterion": "other", "score": 3, "confidence": 2}]' when 3 then 'nothing' else '{"criterion": "Content", "score": 4}' end""")
    criteria = F.from_json(F.lit('[{"name": "Content", "max_points": 10, "levels": [{"label": "low", "points": 2}, {"label": "high", "points": 10}]}, {"name": "Style", "max_points": 5}]'), T.CRITERIA)
    # much work for a row of few bytes: files of a few megabytes would be a task each
    part = m.part.repartition(int(m.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = part.select(F.col("p_partkey").alias("id"), T.structured_items(raw).alias("items")).select("id", T.structured_scores(criteria, F.col("items")).alias("scores"))
    pick = lambda f: F.transform("scores", lambda x: x[f])
    return rows.select("id", G.essay_total(pick("score"), F.lit(15.0)).alias("total"), G.essay_confidence(pick("confidence")).alias("confidence"), T.criteria_feedback("scores").alias("feedback"))


@query("""select p_partkey as id, cast(p_size % 9 + 4 + 2.5e0 as double) as max_points, concat('### ', p_brand, ' (score 0–', p_size % 9 + 4, ' pts)', chr(10), '- high: score ', cast((p_size % 9 + 4 + 1) / 2.0e0 as varchar)[:-3] || replace(right(cast((p_size % 9 + 4 + 1) / 2.0e0 as varchar), 2), '.0', ''), '-', p_size % 9 + 4, ' pts — all of it', chr(10),
  '- low: score 0-', cast((p_size % 9 + 4 + 1) / 2.0e0 as varchar)[:-3] || replace(right(cast((p_size % 9 + 4 + 1) / 2.0e0 as varchar), 2), '.0', ''), ' pts — little', chr(10), '### Rest (score 0–2.5 pts)') as prompt from part""")
def criteria_prompts(m):
    most = (F.col("p_size") % 9 + 4).cast("double")
    level = lambda name, p, said: F.struct(F.lit(name).alias("label"), p.alias("points"), F.lit(said).alias("description"))
    levels = F.array(level("low", F.lit(1.0), "little"), level("high", most, "all of it"))
    item = lambda name, most, levels: F.struct(name.alias("name"), most.alias("max_points"), levels.alias("levels"))
    criteria = F.array(item(F.col("p_brand"), most, levels), item(F.lit("Rest"), F.lit(2.5), F.lit(None).cast("array<struct<label:string,points:double,description:string>>")))
    tops = F.transform(criteria, lambda c: c["max_points"])
    return m.part.select(F.col("p_partkey").alias("id"), F.aggregate(tops, F.lit(0.0), lambda a, x: a + x).alias("max_points"), T.criteria_prompt(criteria).alias("prompt"))


@query("select id as question_id, case question_type when 'essay' then 'essay' when 'identification' then 'short' end as prompt, case when question_type in ('essay', 'identification') then 'essay' end as queued_prompt from exam_questions")
def correction_routing(m):
    return m.exam_questions.select(F.col("id").alias("question_id"), T.correction_prompt("question_type").alias("prompt"), T.correction_prompt("question_type", queued=True).alias("queued_prompt"))


_RUBRICS = """rub as (select p_partkey % 125 as exam_id, p_partkey as row, case p_partkey % 6 when 0 then ' ' when 1 then 'x1' else cast(p_size % 9 as varchar) end as o, case when p_partkey % 4 = 0 then null else p_name end as t from part),
used as (select rub.*, q.id as qid from rub left join exam_questions q on q.exam_id = rub.exam_id and cast(q.order_index as varchar) = rub.o)"""


def _rubrics(m: Model) -> tuple[DataFrame, DataFrame]:
    order = F.expr("case p_partkey % 6 when 0 then ' ' when 1 then 'x1' else cast(p_size % 9 as string) end")
    rows = m.part.select((F.col("p_partkey") % 125).alias("exam_id"), F.col("p_partkey").alias("row"), order.alias("order_index"), F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.col("p_name")).alias("rubric_text"))
    return M.import_rubrics(m.exam_questions.withColumn("rubric_text", F.lit("old")), rows)


@query("select q.id, case when u.n is null then 'old' else u.t end as rubric_text from exam_questions q left join (select qid, arg_max_null(t, row) as t, count(*) as n from used where qid is not null group by 1) u on u.qid = q.id", _RUBRICS)
def rubric_import(m):
    return _rubrics(m)[0].select("id", "rubric_text")


@query("""select exam_id, array_to_string(coalesce(list(e order by row) filter (e is not null), []), chr(10)) as errors, array_to_string(coalesce(list(e order by row) filter (e is not null), [])[-2:], chr(10)) as last_errors, count(*) filter (e is null) as n_updated
  from (select exam_id, row, case when trim(o) = '' then concat('Row ', row, ': missing order_index — skipped') when o = 'x1' then concat('Row ', row, ': order_index ''x1'' is not an integer — skipped') when qid is null then concat('Row ', row, ': no question with order_index ', o, ' — skipped') end as e from used) group by 1""", _RUBRICS)
def rubric_import_errors(m):
    got = M.error_lists(_rubrics(m)[1], "exam_id", most=2)
    return got.withColumns({c: F.array_join(c, "\n") for c in ("errors", "last_errors")})


@query("select id, class_id, student_id from enrollments where student_id % 10 <> 3 or class_id % 2 = 0")
def unenrol(m):
    gone = m.enrollments.where("student_id % 10 = 3 and class_id % 2 = 1").select("class_id", "student_id")
    return M.without(m.enrollments, gone, "class_id", "student_id")[0].select("id", "class_id", "student_id")


@query("select x.i as student_id, x.c as class_id, case when st.id is null then 'not_found' when e.student_id is not null then 'already' else 'added' end as outcome from (select distinct c_custkey * 2 as i, c_nationkey as c from customer) x left join students st on st.id = x.i left join enrollments e on e.student_id = x.i and e.class_id = x.c")
def bulk_enrol(m):
    wanted = m.customer.select((F.col("c_custkey") * 2).alias("student_id"), F.col("c_nationkey").alias("class_id"))
    return M.enrol(m.enrollments, m.students, wanted)[1].select("student_id", "class_id", "outcome")


@query("select submission_answer_id, flag_reason, review_decision from flag_log where submission_answer_id % 3 <> 0")
def flag_delete(m):
    return M.without(m.flag_log, m.answers.where("id % 3 = 0").select(F.col("id").alias("submission_answer_id")), "submission_answer_id")[0]


@query("""select coalesce(f.submission_answer_id, a.id) as submission_answer_id, case when a.id is not null then 'by hand' else flag_reason end as flag_reason, a.id is null as auto_flagged, review_decision from flag_log f
  full join (select id from submission_answers where ai_score = 3) a on a.id = f.submission_answer_id""")
def flags_by_hand(m):
    flags = m.flag_log.select("submission_answer_id", "flag_reason", F.lit(True).alias("auto_flagged"), "review_decision")
    return G.flag_by_hand(flags, m.answers.where("ai_score = 3").select(F.col("id").alias("submission_answer_id"), F.lit("by hand").alias("flag_reason")))


@query("select user_id, event_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_events(m):
    return M.latest(m.events.select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")


@query("select submission_id, array_to_string(list_sort(list(distinct cast(page_number as varchar))), ',') as pages from submission_answers where page_number <> 0 group by 1")
def answer_pages(m):
    pages = F.array_sort(F.collect_set(F.when(F.col("page_number") != 0, F.col("page_number").cast("string"))))
    return m.answers.where("page_number <> 0").groupBy("submission_id").agg(F.array_join(pages, ",").alias("pages"))


@query("select id, case when id % 7 = 0 then concat('#', id) else concat(full_name, ' (#', id, ')') end as label from students")
def enrolment_labels(m):
    return m.students.select("id", S.enrolment_label(F.when(F.col("id") % 7 != 0, F.col("full_name")), "id").alias("label"))


@query("select e.id as exam_id, e.id % 3 = 0 or coalesce(bool_or(question_type not in ('mcq', 'tf')), false) as needs_model from exams e left join (select * from exam_questions where id % 4 = 0) q on q.exam_id = e.id group by e.id")
def model_needed_by_template(m):
    return G.needs_model(m.exam_questions.where("id % 4 = 0"), m.exams, m.exams.where("id % 3 <> 0").select(F.col("id").alias("exam_id")))


@query("""select a.id, case when a.question_id is null and g.fallback_id is null then 'fallback_ocr_ambiguous_question' when ai_score = 0 then 'essay_score_zero' when disc * 5 < 0.4 then 'essay_low_confidence' end as flag,
  case when a.question_id is null and g.fallback_id is null then 'needs_review' else 'graded' end as status from submission_answers a join submissions s on s.id = a.submission_id left join gradable g on g.exam_id = s.exam_id where ai_score is not null""", _EFFECTIVE)
def essay_flags(m):
    rows = A.effective_questions(m.answers, m.submissions, m.exam_questions).where("ai_score is not null").withColumn("confidence", F.col("disc") * 5)
    flag, status = G.essay_flag("ai_score", "confidence", "question_id", "effective_id")
    return rows.select("id", flag.alias("flag"), status.alias("status"))


@query("""select o_orderkey as id, case when (d >= 0.12)::int + (x >= 0.12)::int >= 2 then 'Multiple bubbles marked' when greatest(d, x) < 0.12 then null when d >= x then 'A' else 'B' end as label,
  case when (d >= 0.12)::int + (x >= 0.12)::int >= 2 or greatest(d, x) < 0.12 then 0 else least(1, (greatest(d, x) - least(d, x)) / greatest(d, x)) end as confidence
  from (select l_orderkey as o_orderkey, max(l_discount) * 2 as d, max(l_tax) * 2 as x from lineitem group by 1)""")
def bubble_marks(m):
    rows = m.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg((F.max("l_discount") * 2).alias("d"), (F.max("l_tax") * 2).alias("x"))
    ratios = F.array(F.struct(F.lit("A").alias("label"), F.col("d").alias("ratio")), F.struct(F.lit("B").alias("label"), F.col("x").alias("ratio")))
    mark = G.marks(ratios)
    return rows.select("id", mark["label"].alias("label"), mark["confidence"].alias("confidence"))


@query("""select coalesce(f.submission_answer_id, a.id) as submission_answer_id, coalesce(n, flag_reason) as flag_reason, review_decision from flag_log f
  full join (select id, 'essay_score_zero' as n from submission_answers where ai_score = 1) a on a.id = f.submission_answer_id""")
def flag_upsert(m):
    return G.upsert_flags(m.flag_log, m.answers.where("ai_score = 1").select(F.col("id").alias("submission_answer_id"), F.lit("essay_score_zero").alias("flag_reason")))


@query("""select coalesce(f.submission_answer_id, a.id) as submission_answer_id, coalesce(flag_reason, 'verified') as flag_reason, coalesce(d, review_decision) as review_decision from flag_log f
  full join (select id, 'confirmed_error' as d from submission_answers where ai_score = 2) a on a.id = f.submission_answer_id""")
def flag_review(m):
    return G.review_flags(m.flag_log, m.answers.where("ai_score <= 2").select(F.col("id").alias("submission_answer_id"), F.when(F.col("ai_score") == 2, "confirmed_error").otherwise("bad").alias("decision")))[0]


@query("""select a.id, case when a.sk % 40 - 5 < 0 or coalesce(a.sk % 40 - 5 > q.max_points, false) then 'out_of_range' else 'ok' end as outcome from submission_answers a left join exam_questions q on q.id = a.question_id where a.page_number = 2""")
def override_outcomes(m):
    answers = m.answers.withColumns({"ocr_text": F.lit("x"), "cer": F.lit(None).cast("double"), "wer": F.lit(None).cast("double")})
    changes = m.answers.where("page_number = 2").select("id", (F.col("sk") % 40 - 5).cast("double").alias("score"), F.lit(None).cast("string").alias("reference"))
    return G.override(answers, changes, m.exam_questions)[1]


@query("select e.id as exam_id, coalesce(bool_or(question_type not in ('mcq', 'tf')), true) as needs_model from exams e left join exam_questions q on q.exam_id = e.id group by 1")
def model_needed(m):
    return G.needs_model(m.exam_questions, m.exams)


@query("select * from submissions where status = 'submitted' and id not in (select user_id from events)")
def queue_eligible(m):
    return G.eligible(m.submissions, m.events.select(F.col("user_id").alias("submission_id")))


@query("select user_id as submission_id, min(event_id) as first_event, count(*) as n from events where event_type = 'click' group by 1")
def queue_dedup(m):
    return m.events.where("event_type = 'click'").groupBy(F.col("user_id").alias("submission_id")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("""select conv_id, turn, case when turn % 3 = 0 then least(10, turn) when turn % 3 = 1 then least(10, turn + 0.5e0) else 0 end as score, case turn % 3 when 0 then 'fine' when 1 then 'ok' else concat('reply ', turn) end as feedback, case turn % 3 when 0 then 0.5e0 else 1.0e0 end as confidence from conversations""")
def model_responses(m):
    raw = F.expr("""case turn % 3 when 0 then concat('```json\n{"score": ', turn, ', "feedback": "fine", "confidence": 0.5}\n```')
        when 1 then concat('Sure: "score": ', turn, '.5, and "feedback": "ok" here') else concat('reply ', turn) end""")
    r = T.parse_response(raw, F.lit(10.0))
    return m.conversations.select("conv_id", "turn", r["score"].alias("score"), r["feedback"].alias("feedback"), r["confidence"].alias("confidence"))


@query("""select p_partkey as id, case when s >= (top + mid) / 2 then 'high' when s >= (mid + low) / 2 then 'middle' else 'low' end as level
  from (select p_partkey, 50.0e0 as top, cast(p_size % 20 + 20 as double) as mid, cast(p_size % 10 as double) as low, cast(p_partkey % 51 as double) as s from part)""")
def rubric_levels(m):
    rows = m.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 20 + 20).cast("double").alias("mid"), (F.col("p_size") % 10).cast("double").alias("low"), (F.col("p_partkey") % 51).cast("double").alias("s"))
    level = lambda name, p: F.struct(F.lit(name).alias("label"), p.alias("points"))
    levels = F.array(level("low", F.col("low")), level("high", F.lit(50.0)), level("middle", F.col("mid")))
    return rows.select("id", T.level_of(T.level_bands(levels, F.lit(50.0)), F.col("s")).alias("level"))


@query("select id, student_id, full_name, email from students union all select null, concat('new', c_custkey), c_name, null from customer where c_custkey % 50 = 1")
def student_import(m):
    rows = m.customer.select(F.col("c_custkey").alias("row"), F.when(F.col("c_custkey") % 50 == 1, F.concat(F.lit(" new"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 50 == 2, " ").otherwise(F.col("c_name")).alias("student_id"), F.col("c_name").alias("full_name"), F.lit("").alias("email"))
    return M.import_students(m.students, rows)[0]


@query("select outcome, count(*) as n from (select case c_custkey % 50 when 1 then 'created' when 2 then 'error' else 'skipped' end as outcome from customer) group by 1")
def student_import_outcomes(m):
    rows = m.customer.select(F.col("c_custkey").alias("row"), F.when(F.col("c_custkey") % 50 == 1, F.concat(F.lit(" new"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 50 == 2, " ").otherwise(F.col("c_name")).alias("student_id"), F.col("c_name").alias("full_name"), F.lit("").alias("email"))
    return M.import_students(m.students, rows)[1].groupBy("outcome").count().withColumnRenamed("count", "n")


@query("select * from flag_log where submission_answer_id in (select a.id from submission_answers a join submissions s on s.id = a.submission_id join exams e on e.id = s.exam_id where e.class_id not in (3, 4))")
def cascade_delete(m):
    tables = {n: getattr(m, n) for n in ("course_classes", "exams", "enrollments", "exam_questions", "submissions", "submission_answers", "flag_log")}
    return M.delete_cascade(tables, "course_classes", m.course_classes.where("id in (3, 4)").select("id"))["flag_log"]


@query("select id, submission_id, case when question_id % 10 = 0 then null else question_id end as question_id from submission_answers")
def question_delete(m):
    return M.delete_questions(m.exam_questions, m.answers, m.exams, m.exam_questions.where("id % 10 = 0").select("id"))[1].select("id", "submission_id", "question_id")


@query("""select w.exam_id, w.student_id, s.id as submission_id, case when e.class_id is null then 'not_enrolled' when s.id is not null then 'existing' else 'created' end as outcome
  from (select distinct e.id as exam_id, s.id as student_id from exams e join students s on s.id % 125 = e.id) w join exams x on x.id = w.exam_id left join enrollments e on e.class_id = x.class_id and e.student_id = w.student_id
  left join submissions s on s.exam_id = w.exam_id and s.student_id = w.student_id""")
def get_or_create(m):
    wanted = m.exams.select(F.col("id").alias("exam_id")).join(m.students.select(F.col("id").alias("student_id"), (F.col("id") % 125).alias("exam_id")), "exam_id").select("exam_id", "student_id")
    return M.get_or_create_submissions(m.submissions, wanted, m.exams, m.enrollments)


@query("""select pos, filename, f.student_id, case when pos % 4 = 0 then 'no_qr' when pos % 4 = 1 then 'wrong_exam' when s.sid is null then 'error' when b.id is null and e.student_id is null then 'error' else 'ok' end as outcome,
  case when outcome = 'ok' then 1 + case when b.id % 2 = 0 then 1 else 0 end end as page_number
  from (select c_custkey as pos, concat('f', c_custkey) as filename, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 3 and c_custkey % 3 = 0 then 'nobody' else c_name end as student_id from customer) f
  left join (select id as sid, student_id as code from students) s on s.code = f.student_id left join submissions b on b.student_id = s.sid and b.exam_id = 15
  left join (select student_id from enrollments where class_id = 3) e on e.student_id = s.sid""")
def scan_ingest(m):
    rows = m.customer.select(F.col("c_custkey").alias("pos"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("filename"), F.expr("case when c_custkey % 4 = 0 then 'not json' else concat('{\"exam_id\": ', if(c_custkey % 4 = 1, 16, 15), ', \"student_id\": \"', if(c_custkey % 4 = 3 and c_custkey % 3 = 0, 'nobody', c_name), '\"}') end").alias("payload"))
    files = m.submissions.where("id % 2 = 0").select(F.col("id").alias("submission_id"))
    return M.ingest_scans(rows, 15, m.students, m.submissions, m.exams, m.enrollments, files).select("pos", "filename", "student_id", "outcome", "page_number")


@query("select code, concat(code, '_copy2') as clone from course_classes where id < 5 union all select code, concat(code, '_copy') from course_classes where id >= 5")
def clone_codes(m):
    codes = m.course_classes.select("code").union(m.course_classes.where("id < 5").select(F.concat("code", F.lit("_copy"))))
    return M.clone_codes(codes, m.course_classes.select("code"))


@query("select id, exam_id, order_index, question_type, max_points from exam_questions union all select (select max(id) from exam_questions) + row_number() over (order by q.id), 124 + dense_rank() over (order by q.exam_id), order_index, question_type, max_points from exam_questions q join exams e on e.id = q.exam_id where e.exam_code = 'EX1' and e.class_id = 2")
def exam_duplicate(m):
    one = m.exams.where("exam_code = 'EX1' and class_id = 2").withColumn("exam_code", F.lit("EX1!"))
    exams = m.exams.where("not (exam_code = 'EX1' and class_id = 2)").union(one.select(*m.exams.columns))
    return M.duplicate_exams(exams, m.exam_questions, m.spark.createDataFrame([("EX1!", "EX1_copy")], "code string, clone string"))[1]


@query("select distinct exam_id from exam_questions where id % 50 = 0")
def template_invalidation(m):
    new = m.exam_questions.withColumn("max_points", F.when(F.col("id") % 50 == 0, F.col("max_points") + 1).otherwise(F.col("max_points")))
    return M.invalidate_templates(m.exam_questions, new, ["question_type", "max_points"])


@query("select id, student_id, full_name, case when id % 3 = 0 then concat('new', id) else email end as email from students")
def partial_update(m):
    changes = m.students.where("id % 3 = 0").select("id", F.lit(None).cast("string").alias("full_name"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("email"))
    return M.update_where(m.students, changes, "id", ["full_name", "email"])


@query("select id, submission_id, page_number from submission_answers where not (submission_id = 7 and page_number = 1)")
def page_delete(m):
    return M.delete_page(m.answers, m.flag_log, 7, 1)[0].select("id", "submission_id", "page_number")


@query("""select id, x1, y1, least(2480, x2) as x2, least(3508, y2) as y2 from (select l_orderkey * 7 + l_linenumber as id, greatest(0, cast(trunc((l_quantity - 2.0e0) * 300 / 25.4e0) as int)) as x1, greatest(0, cast(trunc((l_linenumber * 30 - 0.5e0) * 300 / 25.4e0) as int)) as y1,
  cast(trunc((l_quantity + 150 + 2.0e0) * 300 / 25.4e0) as int) as x2, cast(trunc((l_linenumber * 30 + 60 + 2.0e0) * 300 / 25.4e0) as int) as y2 from lineitem)""")
def crop_boxes(m):
    region = F.struct(F.col("l_quantity").alias("x1_mm"), (F.col("l_linenumber") * 30).cast("double").alias("y1_mm"), (F.col("l_quantity") + 150).alias("x2_mm"), (F.col("l_linenumber") * 30 + 60).cast("double").alias("y2_mm"))
    return m.lineitem.select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("id"), L.crop_box(region, F.lit(2480), F.lit(3508)).alias("b")).select("id", "b.*")


@query()
def merged_line_boxes(m):
    box = F.struct(F.col("l_linenumber").alias("x1"), (F.col("l_quantity") * 10).cast("int").alias("y1"), (F.col("l_linenumber") + 500).alias("x2"), (F.col("l_quantity") * 10 + 30).cast("int").alias("y2"))
    rows = m.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return L.merged_lines(rows)


@query()
def answer_similarity(m):
    return m.part.select("p_partkey", match_ratio(F.lower("p_name"), F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name"))).alias("ratio"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(m):
    got = W.windowed(m.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query()
def class_analytics(m):
    return A.class_analytics(m.course_classes, _stats(m))


_PAPER = """select exam_id, id as question_id, order_index, question_type, 1 as page, case when question_type = 'essay' then 15.0e0 else 27.0e0 end as x1_mm,
  round(case when question_type = 'essay' then 58 + 38.5e0 + 4 + (order_index - 4) * (h + 9) + 6 when question_type = 'identification' then 58 + (order_index - 1) * 10 + 1.5e0 else 58 + (order_index - 1) * 10 end, 2) as y1_mm,
  195.0e0 as x2_mm, round(case when question_type = 'essay' then 58 + 38.5e0 + 4 + (order_index - 4) * (h + 9) + 6 + h when question_type = 'identification' then 58 + (order_index - 1) * 10 + 15.5e0 else 58 + (order_index - 1) * 10 + 8.5e0 end, 2) as y2_mm,
  case question_type when 'mcq' then 4 when 'tf' then 2 else 0 end as n_bubbles
  from (select *, greatest(25.0e0, (210 - 38.5e0 - 4 - n * 9) / nullif(n, 0)) as h from (select q.*, count(*) filter (question_type = 'essay') over (partition by exam_id) as n from exam_questions q))"""


@query(_PAPER)
def paper_layout(m):
    return P.regions(m.exam_questions).withColumn("n_bubbles", F.size("bubbles")).drop("bubbles")


@query("""select exam_id, cast(to_json({'dpi': 300, 'page_width_mm': 210.0e0, 'page_height_mm': 297.0e0, 'aruco_dict': 'DICT_4X4_50',
  'aruco_markers': [{'id': 0, 'corner': 'tl', 'x_mm': 10.0e0, 'y_mm': 10.0e0, 'size_mm': 15.0e0}, {'id': 1, 'corner': 'bl', 'x_mm': 10.0e0, 'y_mm': 272.0e0, 'size_mm': 15.0e0}, {'id': 2, 'corner': 'br', 'x_mm': 185.0e0, 'y_mm': 272.0e0, 'size_mm': 15.0e0}],
  'qr_code': {'x_mm': 175.0e0, 'y_mm': 10.0e0, 'size_mm': 25.0e0},
  'questions': list({'order_index': order_index, 'question_id': question_id, 'question_type': question_type, 'page': page, 'x1_mm': x1_mm, 'y1_mm': y1_mm, 'x2_mm': x2_mm, 'y2_mm': y2_mm,
    'bubbles': list_transform(case question_type when 'mcq' then ['A', 'B', 'C', 'D'] when 'tf' then ['True', 'False'] else [] end,
      lambda b, i: {'label': b, 'cx_mm': 30 + (i - 1) * case question_type when 'tf' then 9.0e0 else 7.5e0 end, 'cy_mm': round(y1_mm + 4.25e0, 3), 'r_mm': 3.0e0})} order by question_type = 'essay', order_index)}) as varchar) as template_spec_json
  from paper group by exam_id""", f"paper as ({_PAPER})")
def paper_templates(m):
    return P.template_specs(m.exam_questions)


from quillmark.plans import change_queries, model_queries, report_queries, stream_queries  # noqa: E402, F401  (they register their queries)
