"""Edge rows of the exam model's rules."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import scalar as S
from quillmark.functions.python_parity import match_ratio, py_round
from quillmark.operators import analytics as A
from quillmark.operators import grading as G
from quillmark.operators import layout as L
from quillmark.operators import mutations as M
from quillmark.operators import text as T
from quillmark.sources import files
from quillmark.streaming import queue


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def test_final_scores(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, None, 5.0), (3, None, None)], "i int, teacher_score double, ai_score double")
    assert values(df.orderBy("i").select(S.final_score().alias("a"), S.final_score_or_zero().alias("b")), "a", "b") == [(0, 0), (5, 5), (None, 0)]


def test_white_space_is_pythons(spark):
    texts = ["  a b ", " a\u0085", "\x1fa\x1c b", "", "   ", " x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.select(S.strip("t").alias("s"), S.first_word("t").alias("f"), S.words("t").alias("w"), S.has_text("t").alias("h")).collect()
    assert [r.s for r in got] == [t.strip() for t in texts] and [r.f for r in got] == [(t.split() or [""])[0] for t in texts]
    assert [r.w for r in got] == [t.split() for t in texts] and [r.h for r in got] == [bool(t) for t in texts]


def test_numbers(spark):
    rows = ["1", " 2.5 ", "1d", "7_0", "", None, "-3e2", "x", ".5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i")
    assert values(df.select(S.number("t").alias("n")), "n") == [1, 2.5, None, None, None, None, -300, None, 0.5]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_error_rates(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("aé 漢b  ") for _ in range(rng.randrange(25)))
    pairs = [("", "x"), ("ab", "abcdef"), *((text(), text()) for _ in range(200))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ref string, hyp string")
    got = values(T.transcription_quality(df).orderBy("i"), "cer", "wer")
    rate = lambda r, h: edits(r, h) / len(r) if r else 0.0
    assert got == [(rate(r, h), rate(r.split(), h.split())) for r, h in pairs]


def test_error_rates_of_long_texts(spark, monkeypatch):
    import random

    from quillmark.functions.python_parity import edits as fast

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(14))) for _ in range(120)] + [None, "", " "]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)]
    assert all(fast(a, b) == edits(a, b) for a, b in pairs if a is not None and b is not None)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ref string, hyp string")
    one = df.select("i", S.cer("ref", "hyp").alias("cer"), S.wer("ref", "hyp").alias("wer")).orderBy("i").collect()
    monkeypatch.setattr(T, "LONG", 0)
    monkeypatch.setattr(T, "LONG_IN_WORDS", 0)
    two = df.select("i", T.cer("ref", "hyp").alias("cer"), T.wer("ref", "hyp").alias("wer")).orderBy("i").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two]


def test_python_parity(spark):
    pairs = [("lapulapu", "lapu lapu"), ("tide", "diet"), ("diet", "tide"), ("a" * 210 + "b", "b" + "a" * 210), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert values(df.select(match_ratio("a", "b").alias("r")), "r") == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    df = spark.createDataFrame([(0.125, 2), (2.675, 2), (1.005, 2), (0.35, 1), (None, 1)], "x double, d int")
    assert values(df.select(py_round("x", "d").alias("r")), "r") == [0.12, 2.67, 1.0, 0.3, None]


def test_objective_scores(spark):
    rows = [("b", "B"), ("B x", "B"), ("xB", "B"), ("", "B"), ("  ", "B"), ("Multiple bubbles marked", "B"), (None, "B"), ("B", None)]
    df = spark.createDataFrame([(i, t, c, 5.0, 0.9) for i, (t, c) in enumerate(rows)], "i int, ocr_text string, correct_answer string, max_points double, omr_confidence double")
    got = values(G.score_objective(df).orderBy("i"), "score", "new_status", "flag")
    g, n = "graded", "needs_review"
    assert got == [(5, g, None), (5, g, None), (0, g, None), (None, None, None), (0, n, "omr_no_detection"), (0, n, "omr_multiple_marks"), (None, None, None), (0, g, None)]


def test_identification(spark):
    rows = [("Lapulapu", "Lapu Lapu"), ("Rizal", " rizal "), ("Rizal", "Bonifacio"), ("abcdef", "abcxyf"), ("x", None)]
    df = spark.createDataFrame([(i, c, t, 10.0) for i, (c, t) in enumerate(rows)], "i int, correct_answer string, ocr_text string, max_points double")
    assert values(G.score_identification(df).orderBy("i"), "score", "verdict", "flag") == [(10, "close", None), (10, "exact", None), (0, "none", "identification_no_match"), (5, "partial", None), (None, None, None)]


def test_bubbles(spark):
    rows = [[("A", 0.5), ("B", 0.1)], [("A", 0.5), ("B", 0.12)], [("A", 0.1), ("B", 0.05)], [("A", 0.15), ("B", 0.11)], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<struct<label:string,ratio:double>>")
    got = values(df.orderBy("i").select(G.marks(F.col("r")).alias("m")).select("m.*"), "label", "confidence")
    assert [a for a, _ in got] == ["A", G.MULTIPLE, None, "A", None] and [round(c, 3) for _, c in got] == [0.8, 0, 0, 0.267, 0]


def test_levels(spark):
    levels = [("mid", 3.0), ("low", 2.0), ("top", 5.0)]
    df = spark.createDataFrame([(i, levels, s) for i, s in enumerate([4.0, 3.99, 2.5, 2.49, 9.0])], "i int, l array<struct<label:string,points:double>>, s double")
    bands = T.level_bands(F.col("l"), F.lit(5.0))
    assert values(df.orderBy("i").select(T.level_of(bands, F.col("s")).alias("x")), "x") == ["top", "mid", "mid", "low", "low"]


def test_responses(spark):
    rows = ['{"score": 7, "feedback": "ok", "confidence": 0.4}', '```json\n{"score": 99, "feedback": "f"}\n```', 'I think "score": 3.5 and "feedback": "b\\"c" x', "no idea", '{"score": 4}', '[{"score": 1, "feedback": "x"}]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string").orderBy("i")
    got = values(df.select(T.parse_response("raw", F.lit(10.0)).alias("p")).select("p.*"), "score", "feedback", "confidence")
    assert got[0] == (7, "ok", 0.4) and got[1] == (10, "f", 1) and got[2] == (3.5, "b\\", 1) and got[3] == (0, "no idea", 1) and got[4][0] == 4 and got[5][:2] == (1, "x")


def test_criteria_match_by_name_then_place(spark):
    c = spark.createDataFrame([(1, 0, "Clarity", 5.0), (1, 1, "Depth", 5.0), (1, 2, "Style", 5.0)], "id int, pos int, name string, max_points double")
    r = spark.createDataFrame([(1, 0, " depth", 9.0, 0.5), (1, 1, "other", 2.0, 0.7)], "id int, pos int, name string, score double, confidence double")
    got = {r.name: (r.score, r.confidence, r.missing) for r in T.match_criteria(c, r).collect()}
    assert got == {"Clarity": (5.0, 0.5, False), "Depth": (5.0, 0.5, False), "Style": (0.0, 0.0, True)}


def test_criteria_without_names_or_confidence(spark):
    c = spark.createDataFrame([(1, 0, "Clarity", 5.0), (1, 1, " ", 5.0), (1, 2, "Style", 5.0)], "id int, pos int, name string, max_points double")
    r = spark.createDataFrame([(1, 0, "clarity", 4.0, None), (1, 1, "x", 2.0, 0.7), (1, 2, "", None, None)], "id int, pos int, name string, score double, confidence double")
    got = {r.name: (r.score, r.confidence, r.missing) for r in T.match_criteria(c, r).collect()}
    assert got == {"Clarity": (4.0, 1.0, False), " ": (2.0, 0.7, False), "Style": (0.0, 1.0, False)}


def test_structured_replies(spark):
    levels = [("low", 0.0, "l"), ("high", 4.0, "h")]
    criteria = [("Clarity", 4.0, levels), (None, 2.5, None)]
    rows = ['[{"criterion":"CLARITY","score":9,"justification":""},{"score":"1.25"}]', "[]", None, '[1, {"criterion": "Criterion 2", "score": null, "confidence": "?"}]', 'a {"criterion":"z","score":1} b {"criterion":"clarity","score":2,"confidence":0.5}']
    df = spark.createDataFrame([(i, r, criteria) for i, r in enumerate(rows)], f"i int, raw string, criteria {T.CRITERIA}").orderBy("i")
    got = [[(x.criterion, x.score, x.confidence, x.level) for x in r.s] for r in df.select(T.structured_scores("criteria", T.structured_items("raw")).alias("s")).collect()]
    none = [("Clarity", 0, 0, "low"), ("Criterion 2", 0, 0, "")]
    assert got[0] == [("Clarity", 4, 1, "high"), ("Criterion 2", 1.25, 1, "")] and got[1] == none
    assert got[3][1] == ("Criterion 2", 0, 1, "") and got[4] == [("Clarity", 2, 0.5, "high"), ("Criterion 2", 2, 0.5, "")]
    text = df.where("i = 0").select(T.criteria_feedback(T.structured_scores("criteria", T.structured_items("raw"))).alias("x")).first().x
    assert text == "Clarity: 4/4 (high) — (no justification provided); Criterion 2: 1.25/2.5 — (no justification provided)"
    long = spark.createDataFrame([([("c", 1.0, 1.0, 1.0, "j" * 2000, "")],)], "s array<struct<criterion:string,max_points:double,score:double,confidence:double,justification:string,level:string>>")
    assert len(long.select(T.criteria_feedback("s").alias("x")).first().x) == 1500


def test_numbers_as_text(spark):
    x = [0.0, 1.0, 2.5, 1 / 3, 12.3456789, 99999.5, 0.00012345678, -3.25]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i")
    assert [float(t) for t in values(df.select(S.general("v").alias("t")), "t")] == [float(f"{v:g}") for v in x] and values(df.select(S.general("v").alias("t")), "t")[:4] == ["0", "1", "2.5", "0.333333"]
    assert values(df.select(S.percent(F.col("v") / 100).alias("t")), "t")[:4] == ["0%", "1%", "2%", "0%"]


def test_merged_boxes():
    import random

    # a chain merges as it grows; half of the shorter height isn't enough; a tall box takes what lies in it
    assert L.merge_boxes([(0, 0, 5, 10), (9, 4, 12, 14), (2, 8, 3, 18)]) == [(0, 0, 12, 18)]
    assert L.merge_boxes([(0, 0, 5, 10), (0, 5, 5, 15)]) == [(0, 0, 5, 10), (0, 5, 5, 15)]
    assert L.merge_boxes([(3, 20, 4, 22), (0, 0, 9, 30), (5, 40, 6, 50)]) == [(0, 0, 9, 30), (5, 40, 6, 50)] and L.merge_boxes([]) == []
    # a box joins the first line that it shares with, not the best one
    assert L.merge_boxes([(0, 0, 1, 12), (2, 8, 3, 18), (4, 6, 5, 14)]) == [(0, 0, 5, 18)]
    rng = random.Random(6)
    for _ in range(2000):
        boxes = []
        for _ in range(rng.randrange(1, 9)):
            x, y = rng.randrange(40), rng.randrange(60)
            boxes.append((x, y, x + rng.randrange(1, 40), y + rng.randrange(1, 25)))
        got = L.merge_boxes(boxes)
        assert L.merge_boxes(got) == got and L.merge_boxes(boxes[:1]) == boxes[:1]
        assert all(any(m[0] <= b[0] and m[1] <= b[1] and m[2] >= b[2] and m[3] >= b[3] for m in got) for b in boxes)
        for k, f in enumerate((min, min, max, max)):
            assert f(m[k] for m in got) == f(b[k] for b in boxes) and {m[k] for m in got} <= {b[k] for b in boxes}
        spans = [(m[1], m[3]) for m in got]
        assert all(2 * (min(p[1], q[1]) - max(p[0], q[0])) <= min(p[1] - p[0], q[1] - q[0]) for i, p in enumerate(spans) for q in spans[:i])


def test_text_helpers(spark):
    df = spark.createDataFrame([("a | b||  c ", " x  y \n\n z\t", 'short', "let me see")], "c string, t string, raw string, corr string")
    r = df.select(S.choices_json("c").alias("c"), S.collapse_lines("t").alias("t"), T.is_runaway("raw", "corr").alias("r"), T.is_runaway("raw", "raw").alias("n"), S.latin1(F.lit("a😀é")).alias("l"), T.qr_payload(F.lit('{"exam_id": 3}')).alias("q")).first()
    assert (r.c, r.t, r.r, r.n, r.l, r.q.exam_id) == ('["a","b","c"]', "x y\nz", True, False, "a?é", 3)


def test_flag_statistics_example(spark):
    exams = spark.createDataFrame([(1,)], "id int")
    subs = spark.createDataFrame([(1, 1)], "id int, exam_id int")
    q = spark.createDataFrame([(1, 20.0)], "id int, max_points double")
    a = spark.createDataFrame([(1, 1, 1, 12.0, 15.0)], "id int, submission_id int, question_id int, ai_score double, teacher_score double")
    f = spark.createDataFrame([(1, "verified", "verified")], "submission_answer_id int, flag_reason string, review_decision string")
    r = A.flag_stats(exams, subs, a, q, f).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.n_flagged) == (0, 0, 1, 1, None, 0.0, 0)


def test_imports(spark):
    shape = "exam_id int, row int, prompt string, question_type string, rubric_text string, max_points string, choices string, correct_answer string"
    raw = [
        (1, 2, None, "mcq", "r", "5", "a|b", " a "), (1, 3, "P", "essay", None, None, None, None), (1, 4, " Q ", "", " r ", "abc", "x|y", None), (1, 5, "", "TF", None, "", "t|f", "t"),
        (2, 2, None, "  ", None, "nan", None, None), (2, 3, " ", None, "r", "1e1", None, None),
    ]
    got = values(M.import_questions(spark.createDataFrame(raw, shape), spark.createDataFrame([(1, 1)] * 7, "exam_id int, id int")).orderBy("exam_id", "row"), "error", "order_index", "prompt", "rubric_text", "max_points", "choices_json", "correct_answer")
    assert got == [
        (None, 8, "Question 8", None, 5.0, '["a","b"]', "a"), ("Row 3: missing rubric_text for essay question — skipped", None, "P", None, 10.0, None, None),
        (None, 9, "Q", "r", 10.0, None, None), (None, 10, "Question 10", None, 10.0, None, "t"),
        ("Row 2: invalid question_type '' — must be one of essay, mcq, tf, identification — skipped", None, "", None, 10.0, None, None), (None, 1, "Question 1", "r", 10.0, None, None),
    ]
    old = spark.createDataFrame([("s1", "A", None)], "student_id string, full_name string, email string")
    new = spark.createDataFrame([(2, " s1 ", "B", ""), (3, "s2", "C", ""), (4, "s2", "D", ""), (5, "", "E", "")], "row int, student_id string, full_name string, email string")
    out, outcomes = M.import_students(old, new)
    assert sorted(values(out, "student_id", "full_name")) == [("s1", "A"), ("s2", "C")] and sorted(values(outcomes, "row", "outcome")) == [(2, "skipped"), (3, "created"), (4, "skipped"), (5, "error")]
    crit = [("Depth", "hi", "5", "d"), (None, " ", "", " "), ("depth", "lo", "2", "d"), ("Form", "x", "bad", "d"), (" ", "x", "9", ""), ("Form", "", "99", "no label"), ("Form", "y", "", ""), ("Last", "z", "-1", None)]
    crit = spark.createDataFrame([(i, *c) for i, c in enumerate(crit, 2)], "row int, criterion_name string, level_label string, level_points string, level_description string")
    good, bad = M.rubric_criteria(crit)
    assert [(r.place, r.name, r.max_points, [tuple(x) for x in r.levels]) for r in good.orderBy("place").collect()] == [
        (1, "Depth", 5.0, [("hi", 5.0, "d"), ("lo", 2.0, "d")]), (2, "Form", 0.0, []), (3, "Last", 0.0, [("z", -1.0, "")])
    ]
    # blank rows are left out before rows are numbered
    assert values(bad.orderBy("row"), "row", "error") == [(4, "Row 4: level_points 'bad' is not a number — level skipped"), (5, "Row 5: missing criterion_name — skipped")]
    assert M.rubric_criteria(crit.limit(0))[0].count() == 0


def test_answers_survive_recognition_again(spark):
    old = spark.createDataFrame([(1, 10, 1, "old", 4.0), (1, None, 2, "page", 3.0)], "submission_id int, question_id int, page_number int, ocr_text string, ai_score double")
    new = spark.createDataFrame([(1, 10, 1, "first"), (1, 10, 2, "last"), (1, 11, 1, "fresh")], "submission_id int, question_id int, page_number int, ocr_text string")
    out = M.upsert_answers(old, new, ["ocr_text", "page_number"])
    assert sorted(values(out, "question_id", "ocr_text", "ai_score"), key=str) == sorted([(10, "last", 4.0), (None, "page", 3.0), (11, "fresh", None)], key=str)


def test_image_kernels(spark):
    flat, edge = np.full((9, 9), 7, np.uint8), np.zeros((9, 9), np.uint8)
    edge[4] = 255
    assert L.laplacian_variance(flat) == 0 and L.laplacian_variance(edge) > 80
    page = np.full((60, 60), 255, np.uint8)
    page[20:31, 20:31] = 0
    assert L.fill_ratio(page, 25, 25, 5) == 1.0 and L.fill_ratio(page, 50, 50, 5) == 0.0
    assert L.has_ink(page, (15, 15, 40, 40)) and not L.has_ink(page, (40, 40, 60, 60)) and not L.has_ink(page, (70, 70, 80, 80))
    assert L.merge_boxes([(0, 0, 10, 10), (5, 2, 20, 12), (0, 30, 9, 40)]) == [(0, 0, 20, 12), (0, 30, 9, 40)]
    df = spark.createDataFrame([(1, 9, 9, flat.tobytes()), (2, 9, 9, edge.tobytes())], "id long, width int, height int, gray binary")
    assert values(L.sharpness(df).orderBy("id"), "is_blurred") == [True, False]
    b = spark.createDataFrame([(1, 60, 60, page.tobytes(), [("A", 25, 25, 5), ("B", 50, 50, 5)])], "id long, width int, height int, gray binary, bubbles array<struct<label:string,cx:int,cy:int,r:int>>")
    assert [(r.label, r.ratio) for r in L.bubble_ratios(b).first().ratios] == [("A", 1.0), ("B", 0.0)]


def test_files(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_bytes('﻿ Student_ID ,Full_Name\ns1,"A ""q"" b"\ns2,"two\nlines"\n'.encode())
    df = files.read_csv(spark, str(p), ("student_id", "full_name"))
    assert sorted(values(df, "row", "student_id", "full_name")) == [(2, "s1", 'A "q" b'), (3, "s2", "two\nlines")]
    (tmp_path / "l.csv").write_bytes("name\nJos\xe9\n".encode("latin-1"))
    assert values(files.read_csv(spark, str(tmp_path / "l.csv")), "name") == ["José"]
    with pytest.raises(files.HeaderError):
        files.read_csv(spark, str(p), ("email",))
    (tmp_path / "i.csv").write_text("name,StudentID\nx, a1 \ny,\nz,a2\n")
    assert sorted(values(files.read_ids(spark, str(tmp_path / "i.csv")), "student_id")) == ["a1", "a2"]
    (tmp_path / "j.csv").write_text("a1\na2\n")
    assert sorted(values(files.read_ids(spark, str(tmp_path / "j.csv")), "student_id")) == ["a1", "a2"]
    sheet = files.grade_sheet_columns(spark.createDataFrame([("s1", None)], "student_id string, cer double"))
    files.write_csv(sheet.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿student_id,student_name") and text.splitlines()[1].startswith("s1,,")


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:00:00", i % 4, "enqueue" if i % 2 else "ok", 1.0, "{}") for i in range(12)], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    ev.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "ev"))
    src = lambda: queue.read_events(spark, str(tmp_path / "ev"))
    once = queue.run_available(queue.enqueue_once(src(), "user_id"), "once", "append", str(tmp_path / "c1"))
    assert sorted(values(once, "user_id")) == [0, 1, 2, 3]
    n = queue.run_available(queue.counters(src(), "event_type"), "counts", "complete", str(tmp_path / "c2"))
    assert sorted(values(n, "event_type", "count")) == [("enqueue", 6), ("ok", 6)]
    w = queue.run_available(queue.windowed(src(), late="10 minutes"), "wins", "update", str(tmp_path / "c3"))
    assert sum(values(w, "n")) >= 12


def test_cascade_and_questions(spark):
    t = {"exams": spark.createDataFrame([(1, 1), (2, 1)], "id int, class_id int"), "submissions": spark.createDataFrame([(10, 1), (20, 2)], "id int, exam_id int"), "submission_answers": spark.createDataFrame([(100, 10, 5), (200, 20, 6)], "id int, submission_id int, question_id int"), "flag_log": spark.createDataFrame([(100,), (200,)], "submission_answer_id int"), "exam_questions": spark.createDataFrame([(5, 1), (6, 2)], "id int, exam_id int")}
    out = M.delete_cascade(t, "exams", spark.createDataFrame([(1,)], "id int"))
    assert {k: v.count() for k, v in out.items()} == {k: 1 for k in t} and values(out["flag_log"], "submission_answer_id") == [200]


def test_two_column_paper(spark):
    from quillmark.operators import paper as P

    kinds = ["mcq"] * 6 + ["identification"] * 5 + ["essay"] * 2 + ["tf"]
    df = spark.createDataFrame([(1, 100 + i, i + 1, k, '["a","b","c"]' if k == "mcq" else None) for i, k in enumerate(kinds)], "exam_id int, id int, order_index int, question_type string, choices_json string")
    got = {r.order_index: r for r in P.regions(df).collect()}
    y, want = {0: 58.0, 1: 58.0}, {}
    objective = [i for i, k in enumerate(kinds, 1) if k != "essay"]
    for place, i in enumerate(objective):
        side = int(place >= 6)
        named = kinds[i - 1] == "identification"
        want[i] = (27.0 + side * 93, round(y[side] + 1.5 * named, 2))
        y[side] += 18.5 if named else 10.0
    assert {i: (got[i].x1_mm, got[i].y1_mm) for i in objective} == want
    tall = max(25.0, (210 - (max(y.values()) - 58) - 4 - 2 * 9) / 2)
    start = max(y.values()) + 4 + 6
    assert [round(got[i].y1_mm, 2) for i in (12, 13)] == [round(start, 2), round(start + tall + 9, 2)]
    assert [b.label for b in got[1].bubbles] == ["A", "B", "C"] and [b.label for b in got[14].bubbles] == ["True", "False"] and got[1].bubbles[1].cx_mm == 37.5


def _merged_plainly(boxes, least=0.5):
    lines = list(boxes)
    while True:
        built = []
        for b in sorted(lines, key=lambda b: b[1]):
            for i, m in enumerate(built):
                shared = min(m[3], b[3]) - max(m[1], b[1])
                if shared > 0 and shared > least * min(m[3] - m[1], b[3] - b[1]):
                    built[i] = (min(m[0], b[0]), min(m[1], b[1]), max(m[2], b[2]), max(m[3], b[3]))
                    break
            else:
                built.append(b)
        if len(built) == len(lines):
            return built
        lines = built


def test_boxes_of_many_groups_merge_at_once(spark):
    import random
    import time

    import numpy as np

    rng = random.Random(8)
    groups = [[] for _ in range(3000)]
    for g in groups[2:]:
        for _ in range(rng.randrange(18)):
            x, y = rng.randrange(-5, 40), rng.randrange(-5, 60)
            g.append((x, y, x + rng.randrange(40), y + rng.randrange(25)))
    groups.append([(i % 7, i * 11 % 4000, i % 7 + 9, i * 11 % 4000 + 12) for i in range(600)])
    want = [_merged_plainly(g) for g in groups]
    df = spark.createDataFrame(list(enumerate(groups)), "id int, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    got = {r.id: [tuple(m) for m in r.merged] for r in L.merged_lines(df).collect()}
    assert got == {i: sorted(w, key=lambda m: (m[1], m[0])) for i, w in enumerate(want)}
    assert [L.merge_boxes(g) for g in groups] == want
    # as many groups as a batch has in well under the time that one after another takes (0.2 ms each at least)
    many = np.array([(i % 4, i % 4 * 9, 9, i % 4 * 9 + 11) for i in range(160_000)])
    began = time.process_time()
    _, sizes = L.merge_groups(many, np.full(40_000, 4))
    assert (sizes == 4).all() and time.process_time() - began < 4


def test_replies_are_judged_in_expressions_that_name_each_step_once(spark):
    levels = [("low", 2.0, None), ("high", 10.0, None)]
    criteria = [("Content", 10.0, levels), ("Style", 5.0, None), (" ", 3.0, [])]
    rows = ['[{"criterion": "style ", "score": 7, "confidence": 0.5, "justification": " ok"}, {"criterion": "Content", "score": "6"}]', 'x {"criterion": "content", "score": 5.9} {"criterion": "CONTENT", "score": 6, "confidence": 2} y', "[null, null]", None, ""]
    df = spark.createDataFrame([(i, r, criteria) for i, r in enumerate(rows)], f"i int, raw string, criteria {T.CRITERIA}")
    judged = df.select("i", T.structured_scores("criteria", T.structured_items("raw")).alias("s"))
    got = {r.i: [(x.criterion, x.score, x.confidence, x.level) for x in r.s] for r in judged.collect()}
    none = [("Content", 0, 0, "low"), ("Style", 0, 0, ""), (" ", 0, 0, "")]
    assert got[0] == [("Content", 6, 1, "high"), ("Style", 5, 0.5, ""), (" ", 0, 0, "")]
    assert got[1] == [("Content", 6, 1, "high"), ("Style", 5, 1, ""), (" ", 0, 0, "")] and got[2] == got[3] == got[4] == none
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 4 and plan.count("array_sort(") <= 2


def test_grading_of_small_rows_is_dealt_to_all_tasks(spark, tmp_path):
    from quillmark.plans import queries as Q

    spark.range(400).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = Q.queries()["structured_grades"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 4 and got.count() == 400
