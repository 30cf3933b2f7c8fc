"""Queries of imports, copies and changes of questions, rubrics and scores, over all exams at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import grading as G
from quillmark.operators import mutations as M
from quillmark.operators.numbering import first_of, numbered
from quillmark.plans.queries import _IDENT, _OBJ, _identification, _objective, query
from quillmark.plans.views import Model

_NEW = """new as (select p_partkey % 125 as exam_id, p_partkey as row, case p_partkey % 7 when 0 then null when 1 then ' ' else concat(p_name, ' ') end as prompt,
  case p_size % 7 when 0 then 'MCQ ' when 1 then 'tf' when 2 then '' when 3 then null when 4 then 'identification' when 5 then 'oral' else ' Essay' end as kind, case when p_partkey % 5 = 0 then null else concat(' ', p_brand) end as rubric,
  case p_partkey % 4 when 0 then 'abc' when 1 then ' 7.5 ' when 2 then null else '' end as points, case when p_partkey % 6 = 0 then ' |' else 'a| b ||c' end as choices, case when p_partkey % 9 = 0 then '  ' else concat(' x', p_size) end as answer from part),
shaped as (select exam_id, row, trim(coalesce(prompt, '')) as prompt, lower(trim(coalesce(nullif(kind, ''), 'essay'))) as kind, trim(coalesce(rubric, '')) as rubric, case when points = ' 7.5 ' then 7.5e0 else 10.0e0 end as points, choices, trim(answer) as answer from new),
judged as (select *, case when kind = 'oral' then concat('Row ', row, ': invalid question_type ''oral'' — must be one of essay, mcq, tf, identification — skipped')
    when kind = 'essay' and rubric = '' then concat('Row ', row, ': missing rubric_text for essay question — skipped') when kind <> 'essay' and answer = '' then concat('Row ', row, ': missing correct_answer for ', kind, ' question — skipped') end as error from shaped)"""


def _new_questions(m: Model) -> DataFrame:
    rows = m.part.selectExpr(
        "p_partkey % 125 as exam_id", "p_partkey as row", "case p_partkey % 7 when 0 then null when 1 then ' ' else concat(p_name, ' ') end as prompt",
        "case p_size % 7 when 0 then 'MCQ ' when 1 then 'tf' when 2 then '' when 3 then null when 4 then 'identification' when 5 then 'oral' else ' Essay' end as question_type",
        "case when p_partkey % 5 = 0 then null else concat(' ', p_brand) end as rubric_text", "case p_partkey % 4 when 0 then 'abc' when 1 then ' 7.5 ' when 2 then null else '' end as max_points",
        "case when p_partkey % 6 = 0 then ' |' else 'a| b ||c' end as choices", "case when p_partkey % 9 = 0 then '  ' else concat(' x', p_size) end as correct_answer",
    )
    return M.import_questions(rows, m.exam_questions)


@query("""select j.exam_id, row, row_number() over (partition by j.exam_id order by row) + coalesce(n, 0) as order_index, case when prompt = '' then concat('Question ', row_number() over (partition by j.exam_id order by row) + coalesce(n, 0)) else prompt end as prompt,
  kind as question_type, case when kind = 'essay' then rubric end as rubric_text, points as max_points, case when kind = 'mcq' and row % 6 <> 0 then '["a","b","c"]' end as choices_json, nullif(answer, '') as correct_answer
  from judged j left join (select exam_id, count(*) as n from exam_questions group by 1) q on q.exam_id = j.exam_id where error is null""", _NEW)
def question_import(m):
    return _new_questions(m).where("error is null").drop("error")


@query("select exam_id, array_to_string(coalesce(list(error order by row) filter (error is not null), []), chr(10)) as errors, count(*) filter (error is null) as created from judged group by 1", _NEW)
def question_import_errors(m):
    got = M.error_lists(_new_questions(m), "exam_id", most=10_000)
    return got.select("exam_id", F.array_join("errors", "\n").alias("errors"), F.col("n_updated").alias("created"))


_CRIT = """cells as (select p_partkey % 40 as exam_id, p_partkey as seq, case p_size % 6 when 0 then 'Depth' when 1 then 'depth ' when 2 then ' DEPTH' when 3 then 'Form' when 4 then '' else concat('Item ', p_size % 3) end as name,
  case when p_partkey % 7 = 0 then ' ' else concat('level ', p_size % 5) end as label, case p_partkey % 9 when 0 then 'many' when 1 then '' else cast(p_size % 11 - 1 as varchar) end as points, case when p_size % 6 = 4 and p_partkey % 7 = 0 then '' else 'said' end as description from part),
filled as (select *, cast(row_number() over (partition by exam_id order by seq) + 1 as bigint) as row from cells where trim(name) <> '' or trim(label) <> '' or trim(points) <> '' or trim(description) <> ''),
criteria as (select exam_id, lower(trim(name)) as k, min(row) as first_row, arg_min(trim(name), row) as name, greatest(0, coalesce(max(case when trim(label) <> '' and points not in ('many', '') then cast(nullif(nullif(points, 'many'), '') as double) end), 0)) as max_points,
  coalesce(list(concat(trim(label), '=', points) order by row) filter (trim(label) <> '' and points not in ('many', '')), []) as levels from filled where trim(name) <> '' group by 1, 2)"""


def _criteria(m: Model) -> tuple[DataFrame, DataFrame]:
    rows = m.part.selectExpr(
        "p_partkey % 40 as exam_id", "p_partkey as row", "case p_size % 6 when 0 then 'Depth' when 1 then 'depth ' when 2 then ' DEPTH' when 3 then 'Form' when 4 then '' else concat('Item ', p_size % 3) end as criterion_name",
        "case when p_partkey % 7 = 0 then ' ' else concat('level ', p_size % 5) end as level_label", "case p_partkey % 9 when 0 then 'many' when 1 then '' else cast(p_size % 11 - 1 as string) end as level_points",
        "case when p_size % 6 = 4 and p_partkey % 7 = 0 then '' else 'said' end as level_description",
    )
    return M.rubric_criteria(rows, ("exam_id",))


@query("select exam_id, row_number() over (partition by exam_id order by first_row) as place, name, max_points, array_to_string(levels, '; ') as levels from criteria", _CRIT)
def rubric_criteria_parse(m):
    levels = F.transform("levels", lambda x: F.concat(x["label"], F.lit("="), x["points"].cast("int").cast("string")))
    return _criteria(m)[0].select("exam_id", "place", "name", "max_points", F.array_join(levels, "; ").alias("levels"))


@query("""select exam_id, row, case when trim(name) = '' then concat('Row ', row, ': missing criterion_name — skipped') else concat('Row ', row, ': level_points ''many'' is not a number — level skipped') end as error
  from filled where trim(name) = '' or points = 'many'""", _CRIT)
def rubric_criteria_errors(m):
    return _criteria(m)[1]


_COPIED = """copied as (select e.*, d.title, d.description, cast((select max(id) from exams) + row_number() over (order by e.id) as bigint) as new_id from exams e join exam_details d on d.exam_id = e.id where e.class_id % 3 = 0 and e.exam_code in ('EX1', 'EX4'))"""


def _copies(m: Model) -> tuple[DataFrame, DataFrame]:
    # codes are those of classes and exams together, so each names one exam
    exams = m.full("exams").withColumn("exam_code", F.concat(F.col("class_id").cast("string"), F.lit("-"), F.col("exam_code"))).withColumn("template_spec_json", F.lit("{}"))
    wanted = exams.where("class_id % 3 = 0 and (exam_code like '%EX1' or exam_code like '%EX4')").select(F.col("exam_code").alias("code"))
    questions = m.full("questions").withColumn("region_json", F.lit("[]"))
    return M.duplicate_exams(exams, questions, M.clone_codes(exams.select(F.col("exam_code").alias("code")), wanted))


@query("""select e.id, e.class_id, concat(e.class_id, '-', e.exam_code) as exam_code, d.title, d.description, '{}' as template_spec_json from exams e join exam_details d on d.exam_id = e.id
  union all select new_id, class_id, concat(class_id, '-', exam_code, '_copy'), concat(title, ' (copy)'), description, null from copied""", _COPIED)
def exam_copies(m):
    return _copies(m)[0].drop("created_at")


@query("""select q.id, q.exam_id, q.order_index, q.question_type, q.max_points, d.prompt, '[]' as region_json from exam_questions q join question_details d on d.question_id = q.id
  union all select (select max(id) from exam_questions) + row_number() over (order by c.new_id, q.order_index, q.id), c.new_id, q.order_index, q.question_type, q.max_points, d.prompt, null from exam_questions q join copied c on c.id = q.exam_id join question_details d on d.question_id = q.id""", _COPIED)
def exam_copy_questions(m):
    return _copies(m)[1]


_CHANGED = """before as (select id, exam_id, order_index, question_type, max_points, 'old' as rubric_text, case when id % 4 = 0 then '[]' end as rules, 'x' as answer from exam_questions),
asked as (select id, case id % 5 when 0 then 'tf ' when 1 then question_type end as kind, case id % 3 when 0 then ' new ' when 1 then ' ' end as rubric_text,
  case id % 7 when 0 then '[{"name":"Depth","levels":[{"label":"a","points":2.5},{"label":"b","points":4.0}]},{"name":"Form"}]' when 1 then 'no json' when 2 then '' end as rules, case id % 2 when 0 then 8.0e0 end as max_points, case id % 11 when 0 then ' ' end as answer from before where id % 6 <> 5),
both_ as (select b.*, a.kind, a.rubric_text as new_text, a.rules as new_rules, a.max_points as new_max, a.answer as new_answer, a.rules is not null and a.rules is distinct from b.rules as ruled,
  coalesce(trim(a.kind) <> b.question_type, false) as kinded from before b join asked a on a.id = b.id),
told as (select *, new_max is not null and new_max <> max_points and not (coalesce(new_rules, '') <> '') as pointed,
  case when ruled and new_rules = 'no json' then 'bad_criteria' when case when kinded then trim(kind) else question_type end in ('mcq', 'tf', 'identification') and new_answer is not null then 'no_answer' else 'ok' end as outcome from both_)"""


def _changed(m: Model) -> tuple[DataFrame, DataFrame]:
    q = m.exam_questions.withColumns({"rubric_text": F.lit("old"), "rubric_criteria_json": F.when(F.col("id") % 4 == 0, "[]"), "correct_answer": F.lit("x"), "prompt": F.lit("p"), "choices_json": F.lit(None).cast("string"), "region_json": F.lit("[1]")})
    rules = """case id % 7 when 0 then '[{"name":"Depth","levels":[{"label":"a","points":2.5},{"label":"b","points":4.0}]},{"name":"Form"}]' when 1 then 'no json' when 2 then '' end as rubric_criteria_json"""
    changes = q.where("id % 6 <> 5").selectExpr(
        "id", "cast(null as string) as prompt", "case id % 5 when 0 then 'tf ' when 1 then question_type end as question_type", "case id % 3 when 0 then ' new ' when 1 then ' ' end as rubric_text", rules,
        "case id % 2 when 0 then double(8) end as max_points", "cast(null as string) as choices_json", "case id % 11 when 0 then ' ' end as correct_answer", "cast(null as bigint) as order_index",
    )
    return M.update_questions(q, changes)


@query("""select b.id, b.exam_id, case when t.outcome = 'ok' and t.kinded then trim(t.kind) else b.question_type end as question_type, case when t.outcome = 'ok' and t.new_text is not null then nullif(trim(t.new_text), '') else b.rubric_text end as rubric_text,
  case when t.outcome = 'ok' and t.ruled and t.new_rules <> '' then 4.0e0 when t.outcome = 'ok' and t.pointed then t.new_max else b.max_points end as max_points,
  case when t.outcome = 'ok' and t.ruled then case when t.new_rules <> '' then 'set' end when b.rules is not null then 'set' end as rules, case when t.outcome = 'ok' and (t.ruled or t.pointed or t.kinded) then null else '[1]' end as region_json
  from before b left join told t on t.id = b.id""", _CHANGED)
def question_update(m):
    return _changed(m)[0].select("id", "exam_id", "question_type", "rubric_text", "max_points", F.when(F.col("rubric_criteria_json").isNotNull(), "set").alias("rules"), "region_json")


@query("select id, outcome, outcome = 'ok' and (ruled or pointed or kinded) as structural from told", _CHANGED)
def question_update_outcomes(m):
    return _changed(m)[1].select("id", "outcome", "structural")


@query("""select a.id, case when o.s is not null then o.s else a.teacher_score end as teacher_score, case when o.s is not null then case when a.sk % 2 = 0 then 0.25e0 else 0.1e0 end end as cer, case when o.s is not null then case when a.sk % 2 = 0 then 1.0e0 else 0.3333e0 end end as wer
  from submission_answers a left join (select a.id, max(s) as s from submission_answers a left join exam_questions q on q.id = a.question_id, lateral (select cast(a.sk % 40 - 5 as double) as s union all select 3.0e0) x where a.page_number = 2 and s >= 0 and s <= coalesce(q.max_points, 1000) group by 1) o on o.id = a.id""")
def override_changes(m):
    text = F.when(F.col("sk") % 2 == 0, "abcd").otherwise("ab c defg")
    answers = m.answers.withColumns({"ocr_text": text, "cer": F.lit(None).cast("double"), "wer": F.lit(None).cast("double")})
    first = m.answers.where("page_number = 2").select("id", (F.col("sk") % 40 - 5).cast("double").alias("score"), F.when(F.col("sk") % 2 == 0, " abcx ").otherwise("ab c defgh").alias("reference"))
    second = first.select("id", F.lit(3.0).alias("score"), "reference")
    return G.override(answers, first.union(second), m.exam_questions)[0].select("id", "teacher_score", "cer", "wer")


@query("select id, exam_id, case when exam_id % 5 <> 2 then 'old' end as rubric_text from exam_questions")
def rubric_clear(m):
    return M.set_null(m.exam_questions.withColumn("rubric_text", F.lit("old")), F.col("exam_id") % 5 == 2, ["rubric_text"]).select("id", "exam_id", "rubric_text")


@query("select id, status, cast(null as varchar) as teacher_note from submissions where id % 2 = 0 union all select id, status, 'noted' from submissions where id % 2 = 1")
def schema_addition(m):
    old = m.submissions.where("id % 2 = 0").select("id", "status")
    return M.add_columns(old, m.submissions.where("id % 2 = 1").select("id", "status", F.lit("noted").alias("teacher_note")))


@query("select id, case when question_id is null or disc * 5 < 0.3 or sk % 6 = 0 then 'needs_review' else 'done' end as status from submission_answers")
def recognition_status(m):
    label = F.when((F.col("sk") % 6 != 0) & F.col("question_id").isNotNull(), "A")
    return m.answers.select("id", G.mark_status(label, F.when(label.isNotNull(), F.col("disc") * 5)).alias("status"))



@query("""select id, concat('Correct answer: ', correct_answer, '. Detected: ', case when ocr_text = 'Multiple bubbles marked' then 'multiple bubbles marked. Incorrect — more than one option was filled in, so no single answer can be credited. ⚠ Please verify on the original scan.'
    else concat(trim(ocr_text), case when upper(split_part(trim(ocr_text), ' ', 1)) = upper(correct_answer) or upper(trim(ocr_text)) = upper(correct_answer) then '. Correct.' else '. Incorrect.' end,
      case when omr_confidence < 0.3 then concat(' ⚠ Low OMR confidence (', cast(round_even(omr_confidence * 100, 0) as bigint), '%).') else '' end) end) as feedback from obj""", _OBJ)
def objective_feedback_bulk(m):
    return _objective(m).select("id", G.objective_feedback(bulk=True).alias("feedback"))


@query("""select id, concat('Expected: ', correct_answer, '. Your answer: ', trim(ocr_text), '. ', case when kind = 0 then 'Exact match.' else concat(case when ratio >= 0.85 then 'Accepted' when ratio >= 0.6 then 'Partial credit' else 'Incorrect' end, ' (fuzzy ', cast(round_even(ratio * 100, 0) as bigint), '%).') end) as feedback,
  correct_answer as expected, case when kind <> 0 then cast(round_even(ratio * 100, 0) as bigint) end as percent from judged""", _IDENT)
def identification_feedback_bulk(m):
    rows = _identification(m).select("id", G.identification_feedback(bulk=True).alias("feedback"))
    return rows.select("id", "feedback", G.parse_identification().alias("p")).select("id", "feedback", "p.expected", "p.percent")


@query("select s.id, s.exam_id, d.created_at, row_number() over (order by d.created_at desc nulls last, s.id) as place from submissions s join submission_details d on d.submission_id = s.id")
def submission_order(m):
    """All submissions in one total order, newest first, numbered without a task that holds them all."""
    return numbered(m.full("submissions").select("id", "exam_id", "created_at"), [F.col("created_at").desc_nulls_last(), F.col("id")], (), "place")


@query("select student_id, s.id, s.status, d.created_at from submissions s join submission_details d on d.submission_id = s.id qualify row_number() over (partition by student_id order by d.created_at desc nulls last, s.id) = 1")
def newest_submissions(m):
    rows = m.full("submissions").select("student_id", "id", "status", "created_at")
    return first_of(rows, ["student_id"], [F.col("created_at").desc_nulls_last(), F.col("id")])


@query("select sum(coalesce(try_cast(p_type as double), 0)) as no_number, sum(case when p_size % 5 = 0 then null else 10.0e0 / (p_size % 5) end) as shares, count(*) filter (p_size % 5 = 0) as none from part")
def guarded_divisions(m):
    """Casts that fail and divisions by zero give null, whatever the session's rules for them are."""
    size = (F.col("p_size") % 5).cast("double")
    share = F.try_divide(F.lit(10.0), size)
    return m.part.agg(F.sum(F.coalesce(F.col("p_type").try_cast("double"), F.lit(0.0))).alias("no_number"), F.sum(share).alias("shares"), F.count_if(share.isNull()).alias("none"))
