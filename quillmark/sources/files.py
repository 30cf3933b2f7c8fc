"""CSV sources with row outcomes, identifier lists, scans, and CSV sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import scalar as S
from quillmark.sources.tabular import table_rows


class HeaderError(ValueError):
    """A required column is missing: the whole file is refused."""


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), normalise: bool = True) -> DataFrame:
    """All columns of the CSV or XLSX files of a path as strings, and `row`, the number of the row in its file (the header
    is row 1). Files may be in UTF-8 or Latin-1, each for itself. Files without the required columns are left out, and
    refused if no other is there; `table_rows` tells what is wrong with each."""
    rows = table_rows(spark, path, required, normalise)
    # names of headers: as many as the files have columns
    names = [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().collect()]
    if not names:
        wrong = rows.where("error is not null").select("error").first()
        if wrong is not None:
            raise HeaderError(wrong[0])
    order = [*[c for c in required if c in names], *sorted(set(names) - set(required))]
    return rows.where("error is null").select("row", *[F.col("cells").getItem(c).alias(c) for c in order])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(student_id) of an identifier list: the column named so (or id, studentid), else the first without a header."""
    raw = spark.read.option("header", False).csv(path)
    head = [str(v or "").strip().lower() for v in raw.first() or []]
    at = next((i for i, v in enumerate(head) if v in ("student_id", "id", "studentid")), None)
    c = raw.columns[at or 0]
    rows = raw.select(S.strip(c).alias("student_id"))
    if at is not None:
        rows = rows.where(F.lower("student_id") != head[at])
    return rows.where(F.length("student_id") > 0)


def read_scans(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of scanned pages."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")


#: The byte order mark that stands once in each file, before the first column's name.
MARK = "\ufeff"
# The columns of the exported sheet.
GRADE_SHEET = ("student_id", "student_name", "question_order", "question_prompt", "question_type", "max_points", "ai_score", "teacher_score", "final_score", "groq_confidence", "omr_confidence", "cer", "wer", "status")


def grade_sheet_columns(df: DataFrame) -> DataFrame:
    """The columns of the exported sheet, as text, null as blank."""
    return df.select(*grade_sheet_cells(df))


def grade_sheet_cells(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in GRADE_SHEET]


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One folder of CSV files with headers; the first column's name carries the byte order mark."""
    out = df.orderBy(*order) if order else df
    out.withColumnRenamed(df.columns[0], MARK + df.columns[0]).write.option("header", True).option("escape", '"').option("emptyValue", "").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_sheets(sheet: DataFrame, path: str, whole: Callable[[DataFrame], DataFrame] | None = None, parts: int | None = None) -> None:
    """The sheets of all exams as CSV files, a folder for each exam; exam_id is told by the folder and by a last column.
    Folders are replaced, so a sheet that is written again is there once; rows stand by student and question.

    With `whole`, `sheet` holds fewer and shorter rows with exam_id and student_id (a submission's, say), which are dealt
    to tasks, and whole(rows) makes the sheet's rows of them where they lie; `parts` is then how many tasks there are."""
    dealt = sheet.repartitionByRange(*([parts] if parts else []), "exam_id", "student_id")
    rows = whole(dealt) if whole else dealt
    out = grade_sheet_columns(rows).columns
    cells = rows.select(F.col("exam_id").alias("exam"), *grade_sheet_cells(rows), F.col("exam_id").cast("string").alias("exam_id"))
    cells = cells.sortWithinPartitions("exam", "student_id", F.col("question_order").cast("int"))
    cells.withColumnRenamed(out[0], MARK + out[0]).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).option("partitionOverwriteMode", "dynamic").partitionBy("exam").csv(path)


def csv_cell(c) -> Column:
    """A quoted cell of a template file."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(S.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
