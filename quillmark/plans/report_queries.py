"""Queries of the served reports; the SQL rounds by printing, which rounds the exact binary value as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions.rounding import with_rounded
from quillmark.operators import analytics as A
from quillmark.operators import reports as R
from quillmark.plans.queries import _TOTALS, FINAL, query

_AT = lambda c, d: f"cast(format('{{:.{d}f}}', {c}) as double)"


def _exams(m):
    return R.exam_report(m.full("exams"), m.exam_questions, m.submissions, m.answers)


def _questions(m):
    return R.question_report(m.full("questions"), m.answers)


@query(f"""select l_orderkey * 7 + l_linenumber as id, {_AT('l_extendedprice * (1 - l_discount) / 7', 0)} as whole, {_AT('l_extendedprice * (1 + l_tax) / 3', 1)} as one, {_AT('l_quantity / 8 + l_discount', 2)} as two,
  {_AT('l_extendedprice / 1024', 4)} as four, {_AT('-l_quantity / 16', 2)} as below from lineitem""")
def rounded_figures(m):
    price, less, tax, n = (F.col(f"l_{c}") for c in ("extendedprice", "discount", "tax", "quantity"))
    one = F.lit(1)
    rows = m.lineitem.select(
        (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("id"), (price * (one - less) / 7).alias("whole"), (price * (one + tax) / 3).alias("one"), (n / 8 + less).alias("two"), (price / 1024).alias("four"), (-n / 16).alias("below")
    )
    return with_rounded(rows, {"whole": 0, "one": 1, "two": 2, "four": 4, "below": 2})


_EXAM_REPORT = f"""exam_report as (select s.exam_id, class_id, e.exam_code, d.title, d.created_at, n_submissions as submission_count, n_graded as graded_count, max_score as max_possible,
  {_AT('avg_score', 2)} as avg_total, {_AT('avg_pct', 1)} as avg_pct, n_pass as pass_count, n_fail as fail_count from exam_stats s join (select id, exam_code from exams) e on e.id = s.exam_id join exam_details d on d.exam_id = s.exam_id)"""
_QUESTION_REPORT = f"""question_report as (select exam_id, cast(row_number() over (partition by exam_id order by order_index, question_id) as int) as place, * exclude (exam_id) from (
  select q.exam_id, q.id as question_id, q.order_index, left(d.prompt, 120) as prompt, q.max_points, {_AT(f'avg({FINAL})', 2)} as avg_score, {_AT(f'min({FINAL})', 2)} as min_score, {_AT(f'max({FINAL})', 2)} as max_score, count({FINAL}) as answer_count
  from exam_questions q join question_details d on d.question_id = q.id left join submission_answers a on a.question_id = q.id group by all))"""


@query("select * from exam_report", f"{_TOTALS}, {_EXAM_REPORT}")
def exam_report(m):
    return _exams(m)


@query("select * from question_report", _QUESTION_REPORT)
def question_report(m):
    return _questions(m)


@query("""select c.id as class_id, c.code as class_code, c.name as class_name, coalesce(n.n, 0) as student_count, e.exam_place, e.exam_id, e.title, e.avg_total, e.avg_pct, e.pass_count, q.place as question_place, q.question_id, q.prompt, q.avg_score
  from course_classes c left join (select class_id, count(*) as n from enrollments group by 1) n on n.class_id = c.id
  left join (select *, cast(row_number() over (partition by class_id order by created_at, exam_id) as int) as exam_place from exam_report) e on e.class_id = c.id left join question_report q on q.exam_id = e.exam_id""", f"{_TOTALS}, {_EXAM_REPORT}, {_QUESTION_REPORT}")
def class_report(m):
    rows = R.class_report(m.course_classes, m.enrollments, _exams(m), _questions(m))
    rows = rows.select("class_id", "class_code", "class_name", "student_count", F.posexplode_outer("exams").alias("p", "e"))
    rows = rows.select("class_id", "class_code", "class_name", "student_count", (F.col("p") + 1).alias("exam_place"), *[f"e.{c}" for c in ("exam_id", "title", "avg_total", "avg_pct", "pass_count")], F.explode_outer("e.questions").alias("q"))
    return rows.select(*[c for c in rows.columns if c != "q"], F.col("q.place").alias("question_place"), "q.question_id", "q.prompt", "q.avg_score")


@query(f"""select student_id, cast(row_number() over (partition by student_id order by created_at, submission_id) as int) as place, submission_id, exam_id, exam_code, exam_title, class_code, status, total_score, max_possible,
  case when max_possible > 0 then {_AT('total_score / max_possible * 100', 1)} end as pct
  from (select st.student_id, d.created_at, s.id as submission_id, s.exam_id, coalesce(e.exam_code, '—') as exam_code, coalesce(x.title, '—') as exam_title, coalesce(c.code, '—') as class_code, s.status, {_AT('t.total', 2)} as total_score, coalesce(q.m, 0) as max_possible
    from students st join submissions s on s.student_id = st.id join submission_details d on d.submission_id = s.id left join (select * from exams where id % 6 <> 0) e on e.id = s.exam_id left join exam_details x on x.exam_id = e.id left join course_classes c on c.id = e.class_id
    left join (select exam_id, sum(max_points) as m from exam_questions where exam_id % 6 <> 0 group by 1) q on q.exam_id = s.exam_id
    left join (select submission_id, sum({FINAL}) as total from submission_answers where {FINAL} is not null group by 1) t on t.submission_id = s.id)""")
def student_report(m):
    known = F.col("id") % 6 != 0
    return R.student_report(m.students, m.full("submissions"), m.full("exams").where(known), m.course_classes, m.exam_questions.where("exam_id % 6 <> 0"), m.answers)


@query(f"""select exam_id, exam_code, n_answers, tp, fp, tn, fn, {_AT('case when tp + fp > 0 then tp / (tp + fp) end', 4)} as precision, {_AT('case when tp + fn > 0 then tp / (tp + fn) end', 4)} as recall
  from (select e.id as exam_id, e.exam_code, count(a.id) as n_answers, count(*) filter (auto and review_decision = 'confirmed_error') as tp, count(*) filter (auto and review_decision = 'false_positive') as fp, count(*) filter (review_decision = 'verified') as tn,
    count(*) filter (a.id is not null and not auto and abs(teacher_score - ai_score) >= greatest(0.5, 0.1 * coalesce(max_points, 10))) as fn
    from exams e left join (select a.*, s.exam_id, f.review_decision, coalesce(f.flag_reason <> 'verified', false) as auto, q.max_points from submission_answers a
      join submissions s on s.id = a.submission_id left join flag_log f on f.submission_answer_id = a.id left join exam_questions q on q.id = a.question_id where a.ai_score is not null) a on a.exam_id = e.id group by 1, 2)""")
def flag_report(m):
    stats = A.flag_stats(m.exams, m.submissions, m.answers, m.exam_questions, m.flag_log)
    return R.flag_report(m.exams, stats).select("exam_id", "exam_code", "n_answers", "tp", "fp", "tn", "fn", "precision", "recall")


@query(f"""select s.exam_id, s.id as submission_id, q.id as question_id, coalesce(st.student_id, cast(s.student_id as varchar)) as student_id, coalesce(st.full_name, 'Unknown') as student_name, q.order_index as question_order, left(d.prompt, 80) as question_prompt,
  q.question_type, q.max_points, a.ai_score, a.teacher_score, {FINAL} as final_score, x.groq_confidence, x.omr_confidence, x.cer, x.wer, case when a.id is null then 'not_submitted' else x.status end as status
  from submissions s join exam_questions q on q.exam_id = s.exam_id join question_details d on d.question_id = q.id left join (select * from students where id % 9 <> 0) st on st.id = s.student_id
  left join (select * from submission_answers where question_id is not null qualify row_number() over (partition by submission_id, question_id order by id desc) = 1) a on a.submission_id = s.id and a.question_id = q.id left join answer_details x on x.id = a.id""")
def grade_sheet_export(m):
    return R.grade_sheet(m.students.where("id % 9 <> 0"), m.submissions, m.full("questions"), m.full("answers"))
