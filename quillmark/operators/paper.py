"""Layout of exam papers as a relation: the answer region and bubbles of each question, for all exams at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import scalar as S

# Fixed values, millimetres on A4: page and content area, objective rows, bubbles, essay boxes.
PAGE = {"width": 210.0, "height": 297.0, "margin": 15.0, "top": 58.0, "bottom": 268.0, "column_gap": 6.0}
ROW, ROW_GAP, LABEL, BOX, BOX_TOP = 8.5, 1.5, 12.0, 14.0, 1.5
RADIUS, SPACING, TF_SPACING = 3.0, 7.5, 9.0
ESSAY_LEAST, ESSAY_LABEL, ESSAY_GAP, SECTION_GAP = 25.0, 6.0, 3.0, 4.0
ONE_COLUMN = 10
DPI = 300
MARKERS = [(0, "tl", 10.0, 10.0), (1, "bl", 10.0, 272.0), (2, "br", 185.0, 272.0)]
MARKER_SIZE, CODE = 15.0, {"x_mm": 175.0, "y_mm": 10.0, "size_mm": 25.0}


def regions(questions: DataFrame) -> DataFrame:
    """(exam_id, question_id, order_index, question_type, page, x1_mm, y1_mm, x2_mm, y2_mm, bubbles) of every question;
    choices are optional (choices_json). Objective questions stand above essays, in two columns if there are more than
    ONE_COLUMN, the left one taking the odd one; essays share what is left of the page. Other types have no region.
    Offsets are running sums over an exam's questions."""
    kind = S.strip(S.type_or_essay())
    choices = F.size(F.from_json("choices_json", "array<string>")) if "choices_json" in questions.columns else F.lit(0)
    q = questions.select("exam_id", F.col("id").alias("question_id"), "order_index", kind.alias("question_type"), choices.alias("__c")).where(F.col("question_type").isin("mcq", "tf", "identification", "essay"))
    essay = F.col("question_type") == "essay"
    exam = Window.partitionBy("exam_id")
    order = Window.partitionBy("exam_id", "__essay").orderBy("order_index", "question_id")
    q = q.withColumn("__essay", essay).withColumn("__n", F.count_if(~F.col("__essay")).over(exam)).withColumn("__e", F.count_if("__essay").over(exam)).withColumn("__i", F.row_number().over(order))
    two = F.col("__n") > ONE_COLUMN
    q = q.withColumn("__right", ~F.col("__essay") & two & (F.col("__i") > F.floor((F.col("__n") + 1) / 2)))
    q = q.withColumn("__h", F.when(F.col("__essay"), 0.0).when(F.col("question_type") == "identification", BOX + 3.0 + ROW_GAP).otherwise(ROW + ROW_GAP))
    column = Window.partitionBy("exam_id", "__essay", "__right").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("__y", F.lit(PAGE["top"]) + F.coalesce(F.sum("__h").over(column), F.lit(0.0)))
    q = q.withColumn("__obj", F.greatest(F.sum(F.when(F.col("__right"), 0.0).otherwise(F.col("__h"))).over(exam), F.sum(F.when(F.col("__right"), F.col("__h")).otherwise(0.0)).over(exam)))
    gap = F.when((F.col("__n") > 0) & (F.col("__e") > 0), SECTION_GAP).otherwise(0.0)
    rest = PAGE["bottom"] - PAGE["top"] - F.col("__obj") - gap
    count = F.greatest(F.col("__e"), F.lit(1)).cast("double")
    box = F.greatest(F.lit(ESSAY_LEAST), (rest - count * (ESSAY_LABEL + ESSAY_GAP)) / count)
    full = PAGE["width"] - 2 * PAGE["margin"]
    width = F.when(two & ~F.col("__essay"), (full - PAGE["column_gap"]) / 2).otherwise(full)
    x = F.when(F.col("__right"), PAGE["margin"] + (full - PAGE["column_gap"]) / 2 + PAGE["column_gap"]).otherwise(PAGE["margin"])
    essay_y = PAGE["top"] + F.col("__obj") + gap + (F.col("__i") - 1) * (box + ESSAY_LABEL + ESSAY_GAP) + ESSAY_LABEL
    named = F.col("question_type") == "identification"
    y1 = F.when(F.col("__essay"), essay_y).when(named, F.col("__y") + BOX_TOP).otherwise(F.col("__y"))
    high = F.when(F.col("__essay"), box).when(named, F.lit(BOX)).otherwise(F.lit(ROW))
    shown = F.when(F.col("__c") > 0, F.least(F.col("__c"), F.lit(4))).otherwise(4)
    labels = F.when(F.col("question_type") == "mcq", F.slice(F.array(*map(F.lit, "ABCD")), F.lit(1), shown)).when(F.col("question_type") == "tf", F.array(F.lit("True"), F.lit("False"))).otherwise(F.array().cast("array<string>"))
    step = F.when(F.col("question_type") == "tf", TF_SPACING).otherwise(SPACING)
    q = q.withColumns({"__x": x, "__w": width, "__y1": y1, "__high": high, "__labels": labels, "__step": step})
    bubble = lambda name, i: F.struct(name.alias("label"), F.round(F.col("__x") + LABEL + i * F.col("__step") + RADIUS, 3).alias("cx_mm"), F.round(F.col("__y1") + ROW / 2, 3).alias("cy_mm"), F.lit(RADIUS).alias("r_mm"))
    left = F.col("__x") + F.when(F.col("__essay"), 0.0).otherwise(LABEL)
    return q.select(
        "exam_id", "question_id", "order_index", "question_type", F.lit(1).alias("page"), F.round(left, 2).alias("x1_mm"), F.round("__y1", 2).alias("y1_mm"),
        F.round(F.col("__x") + F.col("__w"), 2).alias("x2_mm"), F.round(F.col("__y1") + F.col("__high"), 2).alias("y2_mm"), F.transform("__labels", bubble).alias("bubbles"),
    )


def template_specs(questions: DataFrame) -> DataFrame:
    """(exam_id, template_spec_json): page, markers, code and all regions of an exam as one JSON document."""
    r = regions(questions)
    entry = F.struct("order_index", "question_id", "question_type", "page", "x1_mm", "y1_mm", "x2_mm", "y2_mm", "bubbles")
    own = r.groupBy("exam_id").agg(F.sort_array(F.collect_list(F.struct((F.col("question_type") == "essay").alias("__e"), "order_index", entry.alias("q")))).alias("qs"))
    markers = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("corner"), F.lit(x).alias("x_mm"), F.lit(y).alias("y_mm"), F.lit(MARKER_SIZE).alias("size_mm")) for i, c, x, y in MARKERS])
    code = F.struct(*[F.lit(v).alias(k) for k, v in CODE.items()])
    spec = F.struct(F.lit(DPI).alias("dpi"), F.lit(PAGE["width"]).alias("page_width_mm"), F.lit(PAGE["height"]).alias("page_height_mm"), F.lit("DICT_4X4_50").alias("aruco_dict"), markers.alias("aruco_markers"), code.alias("qr_code"), F.transform("qs", lambda x: x["q"]).alias("questions"))
    return own.select("exam_id", F.to_json(spec).alias("template_spec_json"))
