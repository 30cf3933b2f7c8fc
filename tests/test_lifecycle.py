"""Streams: the life cycle with restarts and timers, windows, sessions, late rows, and items once."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.streaming import lifecycle as C
from quillmark.streaming import queue as W

SCHEMA = "submission_id bigint, kind string, message string, ts timestamp"


@pytest.fixture
def store(spark):
    C.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(12), rng.choice(["submitted", "processed", "failed", "graded", "graded", "odd"]), "m", f"2024-01-01 {10 + i // 60:02d}:{i % 60:02d}:00") for i in range(n)]


def put(spark, path, rows):
    spark.createDataFrame(rows, "submission_id bigint, kind string, message string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, checkpoint, **how):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = C.lifecycle(src, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def plain(rows):
    state = {}
    for i, kind, _, _ in sorted(rows, key=lambda r: r[3]):
        step, failures, n, ignored = state.get(i, (0, 0, 0, 0))
        step, failures, what = C.follow(step, failures, kind)
        state[i] = (step, failures, n + 1, ignored + (what == "ignored"))
    return {i: (C.STEPS[s], f, n, g) for i, (s, f, n, g) in state.items()}


def test_steps():
    assert C.follow(0, 0, "submitted") == (1, 0, "moved") and C.follow(1, 0, "graded") == (3, 0, "moved") and C.follow(2, 1, "failed") == (1, 2, "failed")
    assert C.follow(3, 0, "failed") == C.follow(3, 0, "submitted") == (3, 0, "ignored") and C.follow(0, 0, "processed")[2] == C.follow(1, 0, "odd")[2] == "ignored"


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path, store):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = events(240, 1)
    want = plain(rows)
    put(spark, path, [*rows[:100], (None, "submitted", None, "2024-01-01 10:00:00")])
    run(spark, path, out, check, late="1 day", limit="9 days")
    first = spark.read.parquet(out).count()
    put(spark, path, rows[100:170])
    put(spark, path, rows[170:])
    run(spark, path, out, check, late="1 day", limit="9 days")  # another query, from the checkpoint alone
    got = spark.read.parquet(out)
    assert first == 100 and got.count() == 240
    last = got.groupBy("submission_id").agg(F.max("failures").alias("f"), F.count("*").alias("n"), F.count_if(F.col("outcome") == "ignored").alias("g"), F.max_by("status", "ts").alias("s"))
    assert {r.submission_id: (r.s, r.f, r.n, r.g) for r in last.collect()} == want
    batch = C.lifecycle_batch(spark.read.schema(SCHEMA).parquet(path))
    assert {r.submission_id: (r.status, r.failures, r.n_events, r.n_ignored) for r in batch.collect()} == want
    run(spark, path, out, check, late="1 day", limit="9 days")  # nothing new: nothing told twice
    assert spark.read.parquet(out).count() == 240


def test_waiting_is_told_once_and_late_events_are_dropped(spark, tmp_path, store):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, path, [(1, "submitted", None, "2024-01-01 10:00:00"), (2, "submitted", None, "2024-01-01 10:00:00"), (2, "graded", None, "2024-01-01 10:05:00")])
    run(spark, path, out, check, limit="30 minutes", late="1 minute")
    for ts in ("12:00:00", "14:00:00"):
        put(spark, path, [(3, "odd", None, f"2024-01-01 {ts}")])
        run(spark, path, out, check, limit="30 minutes", late="1 minute")
    put(spark, path, [(1, "graded", None, "2024-01-01 10:10:00")])  # hours behind the watermark
    run(spark, path, out, check, limit="30 minutes", late="1 minute")
    got = sorted((r.submission_id, r.status, r.outcome, str(r.ts)) for r in spark.read.parquet(out).collect() if r.submission_id < 3)
    assert got == [(1, "submitted", "moved", "2024-01-01 10:00:00"), (1, "submitted", "stale", "2024-01-01 10:30:00"), (2, "graded", "moved", "2024-01-01 10:05:00"), (2, "submitted", "moved", "2024-01-01 10:00:00")]


def test_windows_sessions_and_late_rows(spark, tmp_path):
    def feed(name, *batches):
        for rows in batches:
            spark.createDataFrame([(i, ts, u, "click", 1.0, None) for i, (ts, u) in enumerate(rows)], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return W.read_events(spark, str(tmp_path / name))

    day = "2024-01-01 "
    src = feed("a", [(day + "10:00:00", 1), (day + "10:20:00", 1), (day + "11:30:00", 1), (day + "10:10:00", 2)], [(day + "18:00:00", 3)], [(day + "18:00:00", 4)], [(day + "10:01:00", 1), (day + "19:00:00", 3)], [(day + "23:00:00", 3)])
    got = W.run_available(W.sessions(src, "30 minutes", "1 hour"), "sess", "append", str(tmp_path / "c1"))
    want = {(1, "10:00", "10:50", 2), (1, "11:30", "12:00", 1), (2, "10:10", "10:40", 1), (3, "18:00", "18:30", 1), (4, "18:00", "18:30", 1), (3, "19:00", "19:30", 1)}
    assert {(r.user_id, f"{r.start:%H:%M}", f"{r.end:%H:%M}", r.n) for r in got.collect()} == want  # the row of 10:01 came too late
    got = W.run_available(W.windowed(src, "1 hour", "30 minutes", "1 hour"), "slide", "append", str(tmp_path / "c2"))
    slide = {(f"{r.start:%H:%M}", r.n) for r in got.collect()}
    assert {("09:30", 3), ("10:00", 3), ("11:00", 1), ("11:30", 1), ("17:30", 2), ("18:00", 2)} <= slide and ("09:30", 4) not in slide
    once = W.run_available(W.enqueue_once(src.where("user_id < 3"), "user_id", "1 hour"), "once3", "append", str(tmp_path / "c3"))
    assert sorted(r.user_id for r in once.collect()) == [1, 2]


class _Handle:
    """Counts what a processor asks of its state and timers."""

    def __init__(self):
        self.kept, self.timers, self.calls = None, set(), 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "getValueState": lambda *_: self, "exists": lambda: self.kept is not None, "get": lambda: self.kept, "update": lambda v: setattr(self, "kept", v),
            "listTimers": lambda: [(t,) for t in self.timers], "deleteTimer": self.timers.discard, "registerTimer": self.timers.add,
        }[name]


def test_a_key_of_many_events_asks_for_its_state_and_timer_once():
    import pandas as pd

    def batch(*kinds, start):
        ts = pd.Timestamp(start) + pd.to_timedelta(range(len(kinds)), unit="us")
        return pd.DataFrame({"kind": kinds, "message": "m", "ts": ts}).sample(frac=1, random_state=1)

    h, cycle = _Handle(), C._Cycle(1000)
    cycle.init(h)
    h.calls = 0
    got = pd.concat(cycle.handleInputRows((5,), iter([batch("submitted", *["processed", "failed"] * 200, start="2024-01-01 10:00:00")]), None))
    at = pd.Timestamp("2024-01-01 10:00:00").value // 10**6
    assert len(got) == 401 and list(got["failures"])[-1] == 200 and h.kept == (1, 200, "m", at) and h.timers == {at + 1000} and h.calls <= 5
    # times aren't cut to milliseconds, so the last of several events of one is the last
    assert got["ts"].is_unique and got["ts"].is_monotonic_increasing and list(got.columns) == ["submission_id", "status", "outcome", "failures", "ts"]
    later = pd.concat(cycle.handleInputRows((5,), iter([batch("odd", start="2024-01-01 10:00:02"), batch("processed", start="2024-01-01 10:00:03")]), None))
    assert list(later["outcome"]) == ["ignored", "moved"] and h.timers == {at + 4000} and h.kept == (2, 200, None, at + 3000)
    list(cycle.handleInputRows((5,), iter([batch("graded", start="2024-01-01 10:00:04")]), None))
    assert h.timers == set() and h.kept[0] == 3
