"""Submissions through their life cycle as a stream: one state for each, kept over restarts.

Events (submission_id, kind, message, ts) of kind submitted, processed, graded or failed. A submission goes from draft to
submitted, ocr_done and graded; an event that would lead backwards, or comes again, changes nothing and is told as
ignored. A submission that waits in one step for longer than a time limit of event time is told as stale once, and
again only after it has moved. Failures count and lead back to submitted, so that the submission can be queued again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmark.functions.scalar import STEPS

OUTPUT = "submission_id bigint, status string, outcome string, failures int, ts timestamp"
_STATE = "step int, failures int, message string, since bigint"
#: The step that an event leads to, and the one that it may come from.
MOVES = {"submitted": (1, (0,)), "processed": (2, (1,)), "graded": (3, (1, 2))}
#: The order of events of one time.
ORDER = {k: i for i, k in enumerate(("submitted", "processed", "failed", "graded"))}


def follow(step: int, failures: int, kind: str) -> tuple[int, int, str]:
    """(step, failures, outcome) after an event."""
    if kind == "failed":
        return (1, failures + 1, "failed") if step in (1, 2) else (step, failures, "ignored")
    to, sources = MOVES.get(kind, (step, ()))
    return (to, failures, "moved") if step in sources else (step, failures, "ignored")


class _Cycle(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cycle", _STATE)

    def _wait(self, step: int, since: int, known: bool) -> None:
        """Replaces the submission's timer, if it has one; those in store are asked for only if it was known before."""
        for t in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if 0 < step < len(STEPS) - 1:
            self.handle.registerTimer(since + self.limit)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state or of a timer is a message to the JVM, so there are a few for a key and none for an event
        before = self.state.get()
        step, failures, message, since = before or (0, 0, None, None)
        events = list(rows)
        kinds, messages = ([v for e in events for v in e[c].tolist()] for c in ("kind", "message"))
        times = np.concatenate([e["ts"].to_numpy("datetime64[us]") for e in events])
        # events of one batch in their own order, whatever order they arrive in
        order = np.lexsort(([ORDER.get(k, len(ORDER)) for k in kinds], times))
        times, moved, told = times[order], False, []
        for i, at in zip(order.tolist(), (times.astype(np.int64) // 1000).tolist(), strict=True):
            step, failures, outcome = follow(step, failures, kinds[i])
            if outcome != "ignored":
                since, message, moved = at, messages[i] if outcome == "failed" else None, True
            told.append((STEPS[step], outcome, failures))
        if moved:
            self._wait(step, since, before is not None)
        self.state.update((step, failures, message, since))
        status, outcome, counts = zip(*told, strict=True)
        yield pd.DataFrame({"submission_id": key[0], "status": status, "outcome": outcome, "failures": counts, "ts": times})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, failures, _, _ = self.state.get()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], STEPS[step], "stale", failures, at)], columns=["submission_id", "status", "outcome", "failures", "ts"])

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, limit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """What becomes of each event, a row for each, and a row of outcome `stale` where a submission waits for longer than
    the limit; needs the RocksDB state store. Events later than the watermark are dropped, null ids too."""
    ms = int(pd.Timedelta(limit).total_seconds() * 1000)
    keyed = events.where("submission_id is not null and ts is not null").select(F.col("submission_id").cast("bigint").alias("submission_id"), "kind", "message", "ts").withWatermark("ts", late)
    return keyed.groupBy("submission_id").transformWithStateInPandas(_Cycle(ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def use_state_store(spark: SparkSession) -> None:
    """Timers and typed state are kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def lifecycle_batch(events: DataFrame) -> DataFrame:
    """(submission_id, status, failures, n_events, n_ignored) after all events, in one pass over each submission's own in
    order: what the stream comes to in the end."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("submitted", "processed", "failed", "graded"))), "kind"), F.lit(0))
    e = events.where("submission_id is not null and ts is not null").groupBy("submission_id").agg(F.sort_array(F.collect_list(F.struct("ts", F.when(rank == 0, 9).otherwise(rank).alias("rank"), "kind"))).alias("e"))
    here = lambda a, *steps: a["step"].isin(*steps)

    def after(a, x):
        failed = (x["kind"] == "failed") & here(a, 1, 2)
        to = F.when(failed, 1)
        for kind, (step, sources) in MOVES.items():
            to = to.when((x["kind"] == kind) & here(a, *sources), step)
        new = to.otherwise(None)
        return F.struct(F.coalesce(new, a["step"]).alias("step"), (a["failures"] + failed.cast("int")).alias("failures"), (a["ignored"] + new.isNull().cast("int")).alias("ignored"))

    zero = F.struct(F.lit(0).alias("step"), F.lit(0).alias("failures"), F.lit(0).alias("ignored"))
    done = e.select("submission_id", F.size("e").alias("n_events"), F.aggregate("e", zero, after).alias("a"))
    return done.select("submission_id", F.get(F.array(*map(F.lit, STEPS)), F.col("a.step")).alias("status"), "a.failures", F.col("n_events").cast("bigint").alias("n_events"), F.col("a.ignored").cast("bigint").alias("n_ignored"))
