"""A place for a language model: prompts asked once each, in Arrow batches, failures asked again in rounds.

The model is a callable `model(prompts, attempt)` that returns, for each prompt of a list, its reply or an exception. It
runs on the executors, so it has to be picklable and to open its own connection. Equal prompts are one prompt. Each
round's replies are kept in the shared checkpoint folder before the next begins, so a lost executor costs at most the
batches that it was working on, and what has been answered isn't asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import scalar as S
from quillmark.operators.numbering import kept

# What tells a passing failure; rounds of questions.
PASSING, ATTEMPTS = ("rate", "429", "500", "503"), 3

Model = Callable[[list[str], int], list]


def no_model(prompts: list[str], attempt: int) -> list:
    """Stands where no model is given."""
    raise NotImplementedError("no language model is given: pass a callable of (prompts, attempt)")


def _is_passing(message: str) -> bool:
    return any(x in message.lower() for x in PASSING)


def ask(prompts: DataFrame, model: Model = no_model, attempts: int = ATTEMPTS, size: int = 64, prompt_col: str = "prompt") -> DataFrame:
    """prompts with reply, error and attempts. A failure that may pass is asked again, up to `attempts` rounds; any other,
    or the last, leaves its message as the error. Null prompts aren't asked and have neither. A reply is stripped."""

    def call(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in range(0, batch.num_rows, size):
                    part = batch.slice(x, size)
                    texts = part.column("text").to_pylist()
                    try:
                        got = list(model(texts, attempt))
                    except NotImplementedError:
                        raise
                    except Exception as e:  # all of a call's prompts fail with it
                        got = [e] * len(texts)
                    if len(got) != len(texts):
                        raise ValueError(f"{len(got)} replies to {len(texts)} prompts")
                    failed = [str(g) or type(g).__name__ if isinstance(g, Exception) else None for g in got]
                    reply = [None if f is not None else (g or "").strip() for g, f in zip(got, failed, strict=True)]
                    again = [f is not None and _is_passing(f) for f in failed]
                    yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text"), pa.array(reply, pa.string()), pa.array(failed, pa.string()), pa.array(again)], ["key", "text", "reply", "error", "again"])

        return run

    key = F.sha2(F.col(prompt_col), 256)
    todo = prompts.where(F.col(prompt_col).isNotNull()).groupBy(key.alias("key")).agg(F.first(prompt_col).alias("text"))
    rounds = []
    for attempt in range(1, attempts + 1):
        got = kept(todo.mapInArrow(call(attempt), "key string, text string, reply string, error string, again boolean"))
        final = got if attempt == attempts else got.where("not again")
        rounds.append(final.select("key", "reply", "error", F.lit(attempt).alias("attempts")))
        todo = got.where("again").select("key", "text")
        if attempt == attempts or todo.isEmpty():
            break
    answers = reduce(DataFrame.unionByName, rounds)
    return prompts.withColumn("__key", key).join(answers.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def _or(c: Column, word: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(word))


def exam_prompts(exams: DataFrame, questions: DataFrame) -> DataFrame:
    """(exam_id, prompt): what a model is told of an exam, from the reports of exams and questions, in order."""
    line = F.concat(
        F.lit("  Q"), _or(F.col("order_index"), "None"), F.lit(" ("), _or(F.col("max_points"), "None"), F.lit(" pts): avg="), _or(F.col("avg_score"), "no data"), F.lit(", min="), _or(F.col("min_score"), "None"),
        F.lit(", max="), _or(F.col("max_score"), "None"), F.lit(", n="), F.col("answer_count").cast("string"), F.lit("\n  Prompt: "), _or(F.col("prompt"), "None"),
    )
    q = questions.select("exam_id", F.struct("place", line.alias("line")).alias("l")).groupBy("exam_id").agg(F.sort_array(F.collect_list("l")).alias("l"))
    e = exams.join(q, "exam_id", "left")
    lines = F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(""))
    said = [
        F.lit("Exam: "), _or(F.col("exam_code"), "None"), F.lit(" — "), _or(F.col("title"), "None"), F.lit("\nSubmissions: "), F.col("submission_count").cast("string"), F.lit(" total, "), F.col("graded_count").cast("string"),
        F.lit(" graded\nMax possible: "), _or(F.col("max_possible"), "0"), F.lit("\nClass average: "), _or(F.col("avg_total"), "None"), F.lit(" pts ("), _or(F.col("avg_pct"), "None"), F.lit("%)\nPass: "), F.col("pass_count").cast("string"),
        F.lit("  Fail: "), F.col("fail_count").cast("string"), F.lit("  (threshold: 60%)\n\nPer-question results:\n"), lines,
    ]
    return e.select("exam_id", F.concat(*said).alias("prompt"))


def student_prompts(students: DataFrame, submissions: DataFrame) -> DataFrame:
    """(student_id, prompt): what a model is told of a student, from the student report, in order."""
    name = F.concat(F.lit("  "), F.col("exam_code"), F.lit(" ("), F.col("class_code"), F.lit("): "))
    scored = F.concat(F.col("total_score").cast("string"), F.lit("/"), _or(F.col("max_possible"), "0"), F.lit(" = "), _or(F.col("pct"), "None"), F.lit("%"))
    line = F.concat(name, F.when(F.col("total_score").isNotNull(), scored).otherwise("not yet graded"), F.lit("  ["), _or(F.col("status"), "None"), F.lit("]"))
    own = submissions.select("student_id", F.struct("place", line.alias("line")).alias("l")).groupBy("student_id").agg(F.sort_array(F.collect_list("l")).alias("l"))
    s = students.select("student_id", "full_name").join(own, "student_id", "left")
    lines = F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("  (none)"))
    head = F.concat(F.lit("Student: "), _or(F.col("full_name"), "None"), F.lit(" ("), S.col("student_id"), F.lit(")\nTotal submissions: "), F.coalesce(F.size("l"), F.lit(0)).cast("string"), F.lit("\n\nSubmission history:\n"))
    return s.select("student_id", F.concat(head, lines).alias("prompt"))
