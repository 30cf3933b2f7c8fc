"""Changes as algebra over snapshots: DataFrames and a change in, new DataFrames and outcomes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import scalar as S
from quillmark.operators.numbering import numbered


def insert_unique(old: DataFrame, new: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes): new rows whose key isn't there, the first of each key; others are skipped."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1
    there = old.select(*key, F.lit(True).alias("__there")).distinct()
    judged = new.withColumn("__first", first).join(there, key, "left").withColumn("outcome", F.when(F.col("__there").isNull() & F.col("__first"), "created").otherwise("skipped"))
    added = judged.where("outcome = 'created'").select(*[c for c in old.columns if c in new.columns])
    return old.unionByName(added, allowMissingColumns=True), judged.select(order, *key, "outcome")


def import_students(old: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (row, student_id, full_name, email): a blank id or name is an error, a known id is skipped."""
    r = rows.select("row", S.strip("student_id").alias("student_id"), S.strip("full_name").alias("full_name"), F.nullif(S.strip("email"), F.lit("")).alias("email"))
    ok = (F.coalesce(F.length("student_id"), F.lit(0)) > 0) & (F.coalesce(F.length("full_name"), F.lit(0)) > 0)
    out, outcomes = insert_unique(old, r.where(ok), ["student_id"], "row")
    errors = r.where(~ok).select("row", "student_id", F.lit("error").alias("outcome"))
    return out, outcomes.unionByName(errors)


# Kinds of questions in the order in which messages name them, those with a correct answer, and the points
# of a question that states none.
QUESTION_TYPES, ANSWERED_TYPES, DEFAULT_POINTS = ("essay", "mcq", "tf", "identification"), ("mcq", "tf", "identification"), 10.0


def _text(c: str) -> Column:
    """A cell without white space at its ends, '' for null."""
    return S.strip(F.coalesce(c, F.lit("")))


def _skipped(row: str, what: Column) -> Column:
    return F.concat(F.lit("Row "), F.col(row).cast("string"), F.lit(": "), what, F.lit(" — skipped"))


def import_questions(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """rows (exam_id, row, prompt, question_type, rubric_text, max_points, choices, correct_answer as text) of any exams,
    judged: (exam_id, row, error, order_index, prompt, question_type, rubric_text, max_points, choices_json,
    correct_answer), error null for accepted rows. Their order_index counts on from the exam's number of questions in row
    order, without gaps. Points that are no number, NaN too, are the default; only mcq has choices, only essays a
    rubric."""
    kind = F.lower(S.strip(F.coalesce(F.nullif("question_type", F.lit("")), F.lit("essay"))))
    r = rows.select(
        "exam_id", "row", _text("prompt").alias("prompt"), kind.alias("question_type"), _text("rubric_text").alias("rubric_text"),
        F.coalesce(S.number("max_points"), F.lit(DEFAULT_POINTS)).alias("max_points"), S.choices_json(F.coalesce("choices", F.lit(""))).alias("choices_json"), _text("correct_answer").alias("correct_answer"),
    )
    kind = F.col("question_type")
    what = (
        F.when(~kind.isin(*QUESTION_TYPES), F.concat(F.lit("invalid question_type '"), kind, F.lit(f"' — must be one of {', '.join(QUESTION_TYPES)}")))
        .when((kind == "essay") & (F.col("rubric_text") == ""), "missing rubric_text for essay question")
        .when((kind != "essay") & (F.col("correct_answer") == ""), F.concat(F.lit("missing correct_answer for "), kind, F.lit(" question")))
    )
    r = r.withColumn("error", _skipped("row", what))
    there = questions.groupBy("exam_id").agg(F.count("*").alias("__there"))
    good = numbered(r.where("error is null"), ["row"], ["exam_id"], "__n").join(there, "exam_id", "left")
    good = good.withColumn("order_index", F.col("__n") + F.coalesce("__there", F.lit(0)))
    every = good.drop("__n", "__there").unionByName(r.where("error is not null"), allowMissingColumns=True)
    used = F.col("error").isNull()
    return every.select(
        "exam_id", "row", "error", "order_index", F.when(used & (F.col("prompt") == ""), F.concat(F.lit("Question "), F.col("order_index").cast("string"))).otherwise(F.col("prompt")).alias("prompt"),
        "question_type", F.when(kind == "essay", F.nullif("rubric_text", F.lit(""))).alias("rubric_text"), "max_points", F.when(kind == "mcq", F.col("choices_json")).alias("choices_json"), F.nullif("correct_answer", F.lit("")).alias("correct_answer"),
    )


def rubric_criteria(rows: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(criteria, errors) of rows (keys, row, criterion_name, level_label, level_points, level_description as text), for
    each combination of keys. Blank rows don't count, the others are numbered from 2 in row order.

    Criteria (keys, place, name, max_points, levels) are told apart without regard to case, in first-seen order and
    spelling; a level needs a label and points; the highest of its levels' points, at least 0, is a criterion's maximum.
    Errors (keys, row, error): a row without a criterion, which is left out, and points that are no number (NaN too),
    which leave out the level only."""
    cells = ("criterion_name", "level_label", "level_points", "level_description")
    r = rows.select(*keys, F.col("row").alias("__row"), *[_text(c).alias(c) for c in cells])
    r = numbered(r.where(F.greatest(*[F.length(c) for c in cells]) > 0), ["__row"], list(keys), "row", 2)
    points = S.number("level_points")
    named = F.col("criterion_name") != ""
    error = F.when(~named, _skipped("row", F.lit("missing criterion_name"))).when(
        (F.col("level_points") != "") & points.isNull(), F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": level_points '"), F.col("level_points"), F.lit("' is not a number — level skipped"))
    )
    level = F.when((F.col("level_label") != "") & points.isNotNull(), F.struct("row", F.col("level_label").alias("label"), points.alias("points"), F.col("level_description").alias("description")))
    c = r.where(named).groupBy(*keys, F.lower("criterion_name").alias("__key")).agg(F.min("row").alias("__first"), F.min_by("criterion_name", "row").alias("name"), F.sort_array(F.collect_list(level)).alias("__l"))
    levels = F.transform("__l", lambda x: F.struct(x["label"].alias("label"), x["points"].alias("points"), x["description"].alias("description")))
    c = numbered(c, ["__first"], list(keys), "place")
    top = F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform("__l", lambda x: x["points"])), F.lit(0.0)))
    return c.select(*keys, "place", "name", top.alias("max_points"), levels.alias("levels")), r.withColumn("error", error).where("error is not null").select(*keys, "row", "error")


#: What clients send and what is stored of a rubric.
_CRITERIA = "array<struct<name:string,levels:array<struct<label:string,points:double,description:string>>>>"


def update_questions(questions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, outcomes) after partial changes (id, prompt, question_type, rubric_text, rubric_criteria_json,
    max_points, choices_json, correct_answer, order_index; null: not given), one for each id, else the greatest counts.

    A new rubric states the maximum: each criterion's is that of its levels, the question's their sum, and a maximum in
    the same change is ignored; '' takes the rubric away. Changes of kind, rubric, maximum or choices are structural: the
    question loses its region. Outcomes (id, exam_id, outcome, structural): not_found, bad_criteria for JSON that is no
    list of criteria, no_answer where a kind with a correct answer ends without one, else ok; only ok ones take effect."""
    given = ("prompt", "question_type", "rubric_text", "rubric_criteria_json", "max_points", "choices_json", "correct_answer", "order_index")
    new = changes.groupBy("id").agg(F.max(F.struct(*given)).alias("__c"))
    j = questions.join(new, "id", "right")
    g = {c: F.col(f"__c.{c}") for c in given}
    criteria = F.from_json(g["rubric_criteria_json"], _CRITERIA, {"mode": "PERMISSIVE"})
    ruled = g["rubric_criteria_json"].isNotNull() & ~g["rubric_criteria_json"].eqNullSafe(F.col("rubric_criteria_json"))
    bad = ruled & (g["rubric_criteria_json"] != "") & (criteria.isNull() | F.exists(criteria, lambda c: c.isNull()))
    tops = F.transform(criteria, lambda c: F.struct(c["name"].alias("name"), F.coalesce(F.array_max(F.transform(c["levels"], lambda v: F.coalesce(v["points"], F.lit(0.0)))), F.lit(0.0)).alias("max_points"), c["levels"].alias("levels")))
    total = F.aggregate(F.transform(tops, lambda c: c["max_points"]), F.lit(0.0), lambda a, x: a + x)
    text = F.when(ruled, F.when(g["rubric_criteria_json"] != "", F.to_json(tops))).otherwise(F.col("rubric_criteria_json"))
    kind = S.strip(g["question_type"])
    derived = g["rubric_criteria_json"].isNotNull() & F.coalesce(F.length(text) > 0, F.lit(False))
    pointed = g["max_points"].isNotNull() & ~g["max_points"].eqNullSafe(F.col("max_points")) & ~derived
    chosen = g["choices_json"].isNotNull() & ~g["choices_json"].eqNullSafe(F.col("choices_json"))
    kinded = g["question_type"].isNotNull() & (kind != S.type_or_essay("question_type"))
    j = j.select(
        "*", text.alias("__text"), F.when(ruled & (g["rubric_criteria_json"] != ""), total).when(pointed, g["max_points"]).otherwise(F.col("max_points")).alias("__max"), bad.alias("__bad"),
        (ruled | pointed | chosen | kinded).alias("structural"), F.when(kinded, kind).otherwise(F.col("question_type")).alias("__kind"),
        F.when(g["correct_answer"].isNotNull(), F.nullif(S.strip(g["correct_answer"]), F.lit(""))).otherwise(F.col("correct_answer")).alias("__answer"),
    )
    lacks = S.strip(S.type_or_essay("__kind")).isin(*ANSWERED_TYPES) & (_text("__answer") == "")
    outcome = F.when(F.col("exam_id").isNull(), "not_found").when(F.col("__bad"), "bad_criteria").when(lacks, "no_answer").otherwise("ok")
    j = j.withColumn("outcome", outcome)
    made = {
        "prompt": F.coalesce(S.strip(g["prompt"]), "prompt"), "question_type": F.col("__kind"), "rubric_text": F.when(g["rubric_text"].isNotNull(), F.nullif(S.strip(g["rubric_text"]), F.lit(""))).otherwise(F.col("rubric_text")),
        "rubric_criteria_json": F.col("__text"), "max_points": F.col("__max"), "choices_json": F.coalesce(g["choices_json"], "choices_json"), "correct_answer": F.col("__answer"), "order_index": F.coalesce(g["order_index"], "order_index"),
        "region_json": F.when(~F.col("structural"), F.col("region_json")),
    }
    done = j.where("outcome = 'ok'").select(*[made[c].alias(c) if c in made else F.col(c) for c in questions.columns])
    return questions.join(done.select("id"), "id", "left_anti").select(*questions.columns).unionByName(done), j.select("id", "exam_id", "outcome", (F.col("structural") & (F.col("outcome") == "ok")).alias("structural"))


def update_where(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the columns of changes where they aren't null; of several changes of a key the greatest counts."""
    new = changes.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in columns])
    return df.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def set_null(df: DataFrame, where, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.coalesce(where, F.lit(False)), F.col(c)).cast(kinds[c]) for c in columns})


def delete_cascade(tables: dict[str, DataFrame], root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the root's rows of the given ids, and without all that hangs on them."""
    links = {
        "course_classes": [("exams", "class_id"), ("enrollments", "class_id")], "students": [("submissions", "student_id"), ("enrollments", "student_id")],
        "exams": [("submissions", "exam_id"), ("exam_questions", "exam_id")], "submissions": [("submission_answers", "submission_id"), ("submission_files", "submission_id")],
        "submission_answers": [("flag_log", "submission_answer_id")],
    }
    out = dict(tables)

    def drop(name: str, gone: DataFrame) -> None:
        for child, column in links.get(name, ()):
            if child in out:
                if "id" in out[child].columns and child in links:
                    drop(child, out[child].join(gone.select(F.col("id").alias(column)), column, "left_semi").select("id"))
                out[child] = out[child].join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*out[child].columns)
        out[name] = out[name].join(gone, "id", "left_anti").select(*out[name].columns)

    drop(root, ids.select("id").distinct())
    return out


def delete_questions(questions: DataFrame, answers: DataFrame, exams: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions go, their answers stay without a question, their exams lose the template."""
    gone = ids.select("id").distinct()
    hit = questions.join(gone, "id", "left_semi").select(F.col("exam_id").alias("id"), F.lit(True).alias("__hit")).distinct()
    a = answers.join(gone.select(F.col("id").alias("question_id"), F.lit(True).alias("__gone")), "question_id", "left")
    a = a.withColumn("question_id", F.when(F.col("__gone").isNull(), F.col("question_id"))).select(*answers.columns)
    e = exams.join(hit, "id", "left")
    if "template_spec_json" in exams.columns:
        e = e.withColumn("template_spec_json", F.when(F.col("__hit").isNull(), F.col("template_spec_json")))
    return questions.join(gone, "id", "left_anti"), a, e.select(*exams.columns)


def get_or_create_submissions(submissions: DataFrame, wanted: DataFrame, exams: DataFrame, enrollments: DataFrame) -> DataFrame:
    """wanted (exam_id, student_id) with outcome: not_enrolled, existing or created; each pair once."""
    w = wanted.distinct().join(exams.select(F.col("id").alias("exam_id"), "class_id"), "exam_id", "left")
    w = w.join(enrollments.select("class_id", "student_id", F.lit(True).alias("__in")).distinct(), ["class_id", "student_id"], "left")
    w = w.join(submissions.groupBy("exam_id", "student_id").agg(F.min("id").alias("submission_id")), ["exam_id", "student_id"], "left")
    return w.select("exam_id", "student_id", "submission_id", F.when(F.col("__in").isNull(), "not_enrolled").when(F.col("submission_id").isNotNull(), "existing").otherwise("created").alias("outcome"))


def ingest_scans(scans: DataFrame, exam_id: int, students: DataFrame, submissions: DataFrame, exams: DataFrame, enrollments: DataFrame, files: DataFrame) -> DataFrame:
    """scans (pos, filename, payload) with outcome, student and page number: the first failing check names it. Pages
    count on from the submission's files in order of arrival."""
    p = F.from_json("payload", "exam_id bigint, student_id string")
    r = scans.select("pos", "filename", p["exam_id"].alias("__exam"), p["student_id"].alias("student_id"))
    r = r.join(students.select("student_id", F.col("id").alias("sid")), "student_id", "left")
    own = submissions.where(F.col("exam_id") == exam_id).select(F.col("student_id").alias("sid"), F.col("id").alias("submission_id"))
    members = enrollments.join(exams.where(F.col("id") == exam_id).select("class_id"), "class_id", "left_semi").select(F.col("student_id").alias("sid"), F.lit(True).alias("__in")).distinct()
    r = r.join(own, "sid", "left").join(members, "sid", "left")
    outcome = (
        F.when(F.col("__exam").isNull(), "no_qr").when(F.col("__exam") != exam_id, "wrong_exam").when(F.col("sid").isNull(), "error")
        .when(F.col("submission_id").isNull() & F.col("__in").isNull(), "error").otherwise("ok")
    )
    r = r.withColumn("outcome", outcome)
    n = files.groupBy("submission_id").agg(F.count("*").alias("__n"))
    place = F.row_number().over(Window.partitionBy("sid", "outcome").orderBy("pos"))
    r = r.join(n, "submission_id", "left")
    return r.select("pos", "filename", "student_id", "submission_id", "outcome", F.when(F.col("outcome") == "ok", F.coalesce("__n", F.lit(0)) + place).alias("page_number"))


def delete_page(answers: DataFrame, flags: DataFrame, submission_id: int, page: int) -> tuple[DataFrame, DataFrame]:
    hit = (F.col("submission_id") == submission_id) & (F.col("page_number") == page)
    return answers.where(~hit), flags.join(answers.where(hit).select(F.col("id").alias("submission_answer_id")), "submission_answer_id", "left_anti")


def upsert_answers(old: DataFrame, new: DataFrame, overwrite: list[str]) -> DataFrame:
    """Answers after recognition: keyed by question, or by page where there is none; the last page wins, and only the
    named columns are overwritten, so scores survive."""
    key = ["submission_id", "__k"]
    k = F.coalesce(F.concat(F.lit("q"), F.col("question_id").cast("string")), F.concat(F.lit("p"), F.col("page_number").cast("string"))).alias("__k")
    last = new.select("*", k).groupBy(*key).agg(F.max_by(F.struct(*new.columns), "page_number").alias("__new")).select("__k", "__new.*")
    fresh = last.select(*key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != "submission_id"], F.lit(True).alias("__hit"))
    return old.select("*", k).join(fresh, key, "full").select(*[F.col("submission_id") if c == "submission_id" else F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in overwrite else F.coalesce(c, f"__{c}").alias(c) if f"__{c}" in fresh.columns else F.col(c) for c in old.columns])


def clone_codes(codes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (code) with the first free of code_copy, code_copy2, code_copy3, ..."""
    stem = F.concat("code", F.lit("_copy"))
    used = codes.select(F.col("code").alias("u")).distinct()
    r = wanted.select("code", stem.alias("__s"))
    # of the n + 1 first candidates one is free where n codes are made from the stem
    stems = used.withColumn("__s", F.regexp_extract("u", r"^(.*_copy)\d*$", 1))
    n = r.join(stems, "__s", "left").groupBy("code", "__s").agg(F.count("u").alias("n"))
    c = n.select("code", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int") + 1), lambda i: F.when(i == 1, F.col("__s")).otherwise(F.concat("__s", i.cast("string"))))).alias("p", "u"))
    return c.join(used, "u", "left_anti").groupBy("code").agg(F.min_by("u", "p").alias("clone"))


def duplicate_exams(exams: DataFrame, questions: DataFrame, clones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clones (code, clone): copies of exams, named so in their titles too, with their questions in order; ids count on
    from the highest. Nothing that a template made is copied."""
    top_e, top_q = exams.agg(F.max("id")).first()[0] or 0, questions.agg(F.max("id")).first()[0] or 0
    hit = numbered(exams.join(clones.select(F.col("code").alias("exam_code"), "clone"), "exam_code"), ["id"], (), "__new", top_e + 1)
    own = {"id": F.col("__new"), "exam_code": F.col("clone"), "title": F.concat("title", F.lit(" (copy)")), "template_spec_json": F.lit(None).cast("string")}
    new = hit.select(*[own[c].alias(c) if c in own else F.col(c) for c in exams.columns])
    q = questions.join(hit.select(F.col("id").alias("exam_id"), F.col("__new").alias("__e")), "exam_id")
    q = numbered(q, ["__e", "order_index", "id"], (), "__new", top_q + 1)
    made = {"id": F.col("__new"), "exam_id": F.col("__e"), "region_json": F.lit(None).cast("string")}
    return exams.unionByName(new), questions.unionByName(q.select(*[made[c].alias(c) if c in made else F.col(c) for c in questions.columns]))


def invalidate_templates(old: DataFrame, new: DataFrame, structural: list[str]) -> DataFrame:
    """(exam_id) of exams whose template falls: a question changed in a structural column, null-safely."""
    o = old.select("id", "exam_id", *[F.col(c).alias(f"__{c}") for c in structural])
    j = o.join(new.select("id", *structural), "id")
    changed = F.lit(False)
    for c in structural:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return j.where(changed).select("exam_id").distinct()


def add_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older and a newer schema together."""
    return old.unionByName(new, allowMissingColumns=True)


def import_rubrics(questions: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, outcomes) after rows (exam_id, row, order_index, rubric_text as strings): rubric_text of the question
    with that exam and order_index (the last of several), blank as null; the last row of a question wins. Outcomes: (exam_id, row, error),
    error null where the row was used."""
    order = S.integer("order_index")
    judged = rows.withColumn("__order", order).withColumn("__text", F.nullif(S.strip(F.coalesce("rubric_text", F.lit(""))), F.lit("")))
    # of questions with one order_index the last is meant
    known = questions.groupBy("exam_id", F.col("order_index").cast("bigint").alias("__order")).agg(F.max("id").alias("__id"))
    judged = judged.join(known, ["exam_id", "__order"], "left")
    raw = S.strip(F.coalesce("order_index", F.lit("")))
    what = F.when(raw == "", "missing order_index").when(F.col("__order").isNull(), F.concat(F.lit("order_index '"), raw, F.lit("' is not an integer"))).when(F.col("__id").isNull(), F.concat(F.lit("no question with order_index "), F.col("__order").cast("string")))
    error = _skipped("row", what)
    last = judged.where("__id is not null").groupBy(F.col("__id").alias("id")).agg(F.max_by(F.struct("__text"), "row").alias("__new"))
    rest = [c for c in questions.columns if c != "rubric_text"]
    done = questions.join(last, "id", "left").select(*rest, F.when(F.col("__new").isNotNull(), F.col("__new.__text")).otherwise(F.col("rubric_text")).alias("rubric_text"))
    return done, judged.select("exam_id", "row", error.alias("error"))


def error_lists(outcomes: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(key, errors in row order, the last `most` of them, n_updated) from outcomes (key, row, error)."""
    errors = F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("row", "error"))))
    got = outcomes.groupBy(key).agg(errors["error"].alias("errors"), F.count_if(F.col("error").isNull()).alias("n_updated"))
    return got.select(key, "errors", F.slice("errors", F.greatest(F.lit(1), F.size("errors") - (most - 1)), F.lit(most)).alias("last_errors"), "n_updated")


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unknown) after the rows with the keys of gone are taken away; unknown: keys that no row has."""
    one = gone.select(*keys).distinct()
    return rows.join(one, list(keys), "left_anti"), one.join(rows.select(*keys).distinct(), list(keys), "left_anti")


def enrol(enrolments: DataFrame, students: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enrolments, outcomes) after wanted (class_id, student_id): outcome not_found, already or added; a pair that is
    asked for twice is added once. New rows have no id."""
    known = students.select(F.col("id").alias("student_id")).distinct().withColumn("__s", F.lit(True))
    there = enrolments.select("class_id", "student_id").distinct().withColumn("__e", F.lit(True))
    asked = wanted.select("class_id", "student_id").distinct().join(known, "student_id", "left").join(there, ["class_id", "student_id"], "left")
    judged = asked.select("class_id", "student_id", F.when(F.col("__s").isNull(), "not_found").when(F.col("__e").isNotNull(), "already").otherwise("added").alias("outcome"))
    new = judged.where("outcome = 'added'").select("class_id", "student_id")
    return enrolments.unionByName(new, allowMissingColumns=True), judged


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given columns; give a unique one last, so that nothing is left to chance."""
    top = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("__t"))
    return top.select(key, "__t.*")
