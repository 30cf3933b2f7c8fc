"""Queries around a language model: what it is told, and replies of a callable that stands for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import model_calls as C
from quillmark.operators import reports as R
from quillmark.plans.queries import _TOTALS, query
from quillmark.plans.report_queries import _EXAM_REPORT, _QUESTION_REPORT, _exams, _questions


@query("""select e.exam_id, concat('Exam: ', exam_code, ' — ', title, chr(10), 'Submissions: ', submission_count, ' total, ', graded_count, ' graded', chr(10), 'Max possible: ', max_possible, chr(10),
    'Class average: ', coalesce(cast(avg_total as varchar), 'None'), ' pts (', coalesce(cast(avg_pct as varchar), 'None'), '%)', chr(10), 'Pass: ', pass_count, '  Fail: ', fail_count, '  (threshold: 60%)', chr(10), chr(10), 'Per-question results:', chr(10), coalesce(lines, '')) as prompt
  from exam_report e left join (select exam_id, string_agg(concat('  Q', order_index, ' (', max_points, ' pts): avg=', coalesce(cast(avg_score as varchar), 'no data'), ', min=', coalesce(cast(min_score as varchar), 'None'), ', max=', coalesce(cast(max_score as varchar), 'None'),
    ', n=', answer_count, chr(10), '  Prompt: ', prompt), chr(10) order by place) as lines from question_report group by 1) q on q.exam_id = e.exam_id""", f"{_TOTALS}, {_EXAM_REPORT}, {_QUESTION_REPORT}")
def exam_prompts(m):
    return C.exam_prompts(_exams(m), _questions(m))


@query(f"""select st.student_id, concat('Student: ', st.full_name, ' (', st.student_id, ')', chr(10), 'Total submissions: ', coalesce(n, 0), chr(10), chr(10), 'Submission history:', chr(10), coalesce(lines, '  (none)')) as prompt
  from students st left join (select student_id, count(*) as n, string_agg(concat('  ', exam_code, ' (', class_code, '): ', case when total_score is null then 'not yet graded' else concat(total_score, '/', max_possible, ' = ', pct, '%') end, '  [', status, ']'), chr(10) order by created_at, submission_id) as lines
    from (select s.student_id, d.created_at, s.id as submission_id, e.exam_code, c.code as class_code, s.status, t.total as total_score, q.m as max_possible, cast(format('{{:.1f}}', t.total / q.m * 100) as double) as pct
      from submissions s join submission_details d on d.submission_id = s.id join exams e on e.id = s.exam_id join course_classes c on c.id = e.class_id join (select exam_id, sum(max_points) as m from exam_questions group by 1) q on q.exam_id = s.exam_id
      left join (select submission_id, sum(coalesce(teacher_score, ai_score)) as total from submission_answers group by 1) t on t.submission_id = s.id) group by 1) h on h.student_id = st.id""")
def student_prompts(m):
    report = R.student_report(m.students, m.full("submissions"), m.full("exams"), m.course_classes, m.exam_questions, m.answers)
    return C.student_prompts(m.students, report)


def stand_in(prompts: list[str], attempt: int) -> list:
    """Replies that follow from the prompt alone; the first try of some fails as a busy server's does, others for good."""
    return [ConnectionError("HTTP 429") if len(p) % 3 == 0 and attempt == 1 else ValueError("refused") if len(p) % 7 == 0 else f" {p.upper()} " for p in prompts]


@query("""select p_partkey as id, case when length(p_type) % 7 <> 0 then upper(p_type) end as reply, case when length(p_type) % 7 = 0 then 'refused' end as error, case when length(p_type) % 3 = 0 then 2 else 1 end as attempts from part""")
def model_replies(m):
    return C.ask(m.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("prompt")), stand_in).drop("prompt")
