"""Queries that run as streams, or write files and read them back; the SQL says what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import reports as R
from quillmark.plans.queries import FINAL, query
from quillmark.plans.views import Model
from quillmark.sources import files, sinks
from quillmark.streaming import lifecycle as C
from quillmark.streaming import queue as W

_KINDS = "case event_type when 'view' then 'submitted' when 'click' then 'processed' when 'purchase' then 'graded' when 'error' then 'failed' else event_type end as kind"
_CYCLE = f"""ev as (select user_id as submission_id, ts, event_id, {_KINDS} from events),
told as (select submission_id, list_reduce(list({{'step': 0, 'failures': 0, 'ignored': 0, 'kind': kind}} order by ts, event_id), lambda a, x: case
    when x.kind = 'failed' and a.step in (1, 2) then {{'step': 1, 'failures': a.failures + 1, 'ignored': a.ignored, 'kind': ''}}
    when x.kind = 'submitted' and a.step = 0 then {{'step': 1, 'failures': a.failures, 'ignored': a.ignored, 'kind': ''}}
    when x.kind = 'processed' and a.step = 1 then {{'step': 2, 'failures': a.failures, 'ignored': a.ignored, 'kind': ''}}
    when x.kind = 'graded' and a.step in (1, 2) then {{'step': 3, 'failures': a.failures, 'ignored': a.ignored, 'kind': ''}}
    else {{'step': a.step, 'failures': a.failures, 'ignored': a.ignored + 1, 'kind': ''}} end, {{'step': 0, 'failures': 0, 'ignored': 0, 'kind': ''}}) as e, count(*) as n from ev group by 1)"""
_CYCLE_SQL = "select submission_id, ['draft', 'submitted', 'ocr_done', 'graded'][e.step + 1] as status, e.failures, n as n_events, cast(e.ignored as bigint) as n_ignored from told"


#: Submissions that one task writes to sheets, about: what it sorts, and the files that others read, stay small.
SUBMISSIONS = 50_000


def _events(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").alias("submission_id"), F.expr(_KINDS), F.lit("").alias("message"), F.col("ts").cast("timestamp").alias("ts"))


def _stream(m: Model) -> DataFrame:
    """The events as a stream, in a session of its own, whose settings touch no other."""
    session = m.spark.newSession()
    C.use_state_store(session)
    # as a pattern, so that the table may be one file or a folder of them
    return W.read_events(session, f"{m.dir}/events.parque[t]", 4)


@query(_CYCLE_SQL, _CYCLE)
def lifecycle_states(m):
    return C.lifecycle_batch(_events(m.events))


@query(_CYCLE_SQL, _CYCLE)
def lifecycle_stream(m):
    # the table is one batch of a stream here; the limit is longer than the time that it covers
    told = sinks.run_stream(C.lifecycle(_events(_stream(m)), limit="36500 days", late="1 day"), "lifecycle", reader=m.spark)
    own = told.groupBy("submission_id").agg(F.max_by("status", "ts").alias("status"), F.max("failures").alias("failures"), F.count("*").alias("n_events"), F.count_if(F.col("outcome") == "ignored").alias("n_ignored"))
    return own.select("submission_id", "status", "failures", "n_events", "n_ignored")


@query("select user_id as submission_id from events where event_type in ('view', 'click') group by 1")
def queue_once(m):
    waiting = _stream(m).where("event_type in ('view', 'click')").select(F.col("user_id").alias("submission_id"), "ts")
    return sinks.run_stream(W.enqueue_once(waiting), "queue", reader=m.spark).select("submission_id")


@query("select event_type as kind, count(*) as count from events group by 1")
def queue_counts(m):
    return sinks.run_stream(W.counters(_stream(m).withColumnRenamed("event_type", "kind")), "counts", "complete", m.spark)


@query(f"""select s.exam_id, coalesce(st.student_id, cast(s.student_id as varchar)) as student_id, st.full_name as student_name, q.order_index as question_order, left(d.prompt, 80) as question_prompt, q.question_type, q.max_points, {FINAL} as final_score, x.cer,
    case when a.id is null then 'not_submitted' else x.status end as status
  from submissions s join exam_questions q on q.exam_id = s.exam_id join question_details d on d.question_id = q.id join students st on st.id = s.student_id
  left join (select * from submission_answers where question_id is not null qualify row_number() over (partition by submission_id, question_id order by id desc) = 1) a on a.submission_id = s.id and a.question_id = q.id left join answer_details x on x.id = a.id""")
def grade_sheet_files(m):
    """Writes the sheets of all exams, one folder for each, twice, and reads them back."""
    folder = sinks.shared_folder(m.spark, "sheets")
    # computed once, a row for each submission; only such rows move before each writing
    questions = sinks.staged(m.full("questions"), "sheet-questions")
    m.deal("lineitem", "l_orderkey")
    rows = sinks.staged(R.sheet_submissions(m.students, m.submissions, m.full("answers")), "sheet-rows")
    parts = max(int(m.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SUBMISSIONS))
    for _ in range(2):
        files.write_sheets(rows, folder, lambda rows: R.sheet_rows(rows, questions), parts)
    back = files.read_csv(m.spark, folder, files.GRADE_SHEET[:1])
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("double").alias(c)
    return back.select(F.col("exam_id").cast("int").alias("exam_id"), "student_id", "student_name", F.col("question_order").cast("int").alias("question_order"), "question_prompt", "question_type", number("max_points"), number("final_score"), number("cer"), "status")
