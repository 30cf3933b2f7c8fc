"""Marker maps, bubble masks, and the place of a language model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import geometry as X
from quillmark.operators import layout as L
from quillmark.operators import model_calls as C


def through(h, p):
    z = np.c_[p, np.ones(len(p))] @ h.T
    return z[:, :2] / z[:, 2:]


def test_maps_are_recovered_with_wrong_corners(spark):
    rng = np.random.default_rng(1)
    template = np.array([[x + dx, y + dy] for x, y in ((50, 50), (2300, 60), (60, 3400), (2310, 3390)) for dx, dy in ((0, 0), (90, 0), (90, 90), (0, 90))], float)
    rows, truth = [], {}
    for page in range(12):
        a = rng.uniform(-0.3, 0.3)
        h = np.array([[np.cos(a), -np.sin(a), rng.uniform(-80, 80)], [np.sin(a), np.cos(a), rng.uniform(-80, 80)], [rng.uniform(-1e-5, 1e-5), rng.uniform(-1e-5, 1e-5), 1]])
        scan = through(np.linalg.inv(h), template) + rng.normal(0, 0.3, template.shape)
        wrong = rng.choice(16, 4, replace=False) if page % 2 else []
        for i in wrong:
            scan[i] += rng.uniform(60, 300, 2)
        truth[page] = (h, len(wrong))
        rows += [(page, i // 4, i % 4, *map(float, p)) for i, p in enumerate(scan)]
    rows += [(100, 0, c, 1.0, 2.0) for c in range(4)] + [(101, 77, 0, 1.0, 1.0), (101, 78, 0, 1.0, 1.0)] + [(102, m, c, 5.0, 5.0) for m in (0, 1) for c in range(4)] + [(103, 0, 0, None, None)]
    corners = spark.createDataFrame(rows, "page_id long, marker_id int, corner int, x double, y double")
    places = spark.createDataFrame([(i // 4, i % 4, *map(float, p)) for i, p in enumerate(template)], "marker_id int, corner int, x double, y double")
    maps = X.page_maps(corners, places)
    got = {r.page_id: r for r in maps.collect()}
    for page, (h, n_wrong) in truth.items():
        own = np.array(got[page].h).reshape(3, 3)
        probe = np.array([[300.0, 300], [1800, 2500], [1000, 1500]])
        assert got[page].inliers == 16 - n_wrong and np.abs(through(own, probe) - through(h, probe)).max() < 3
    assert [(got[p].markers, got[p].h, got[p].inliers) for p in (100, 101, 102, 103)] == [(1, None, 0), (0, None, 0), (2, None, 0), (0, None, 0)]
    moved = maps.where("h is not null").select("page_id", "h", X.mapped(F.col("h"), F.lit(700.0), F.lit(900.0)).alias("m")).select("page_id", "m", X.mapped(X.inverse(F.col("h")), F.col("m.x"), F.col("m.y")).alias("back"))
    assert all(abs(r.back.x - 700) < 1e-6 and abs(r.back.y - 900) < 1e-6 for r in moved.collect())
    assert {r.page_id: r.h for r in X.page_maps(corners.orderBy("y"), places).collect()} == {p: r.h for p, r in got.items()}


def test_tilt(spark):
    up = np.pi / 2
    df = spark.createDataFrame([(1, [up + 0.05, up + 0.03, up + 0.04, 0.1]), (2, [up + 0.001]), (3, [up + 0.5]), (4, [0.0, 0.1]), (5, []), (6, [up - 0.1, up - 0.06])], "id int, t array<double>")
    got = [r.d for r in df.orderBy("id").select(X.tilt(F.col("t")).alias("d")).collect()]
    assert got == pytest.approx([np.degrees(0.04), 0, 0, 0, 0, np.degrees(-0.08)])


def plain_ratio(gray, cx, cy, r):
    """The same rule pixel by pixel."""
    h, w = gray.shape
    if not (0 <= cx < w and 0 <= cy < h):
        return 0.0
    y0, x0, y1, x1 = max(0, cy - 3 * r), max(0, cx - 3 * r), min(h, cy + 3 * r), min(w, cx + 3 * r)
    part = gray[y0:y1, x0:x1].astype(int)
    best, at = 0.0, 0
    for t in range(256):
        a, b = part[part <= t], part[part > t]
        if len(a) and len(b) and (v := len(a) * len(b) * (a.mean() - b.mean()) ** 2) > best * (1 + 1e-12):
            best, at = v, t
    mask = part <= at
    k = max(3, r // 4 * 2 + 1) // 2
    kernel = [(y, x) for y in range(-k, k + 1) for x in range(-k, k + 1) if abs(x) <= round((k * k - y * y) ** 0.5)]

    def step(m, any_):
        out = np.zeros_like(m)
        for i in range(m.shape[0]):
            for j in range(m.shape[1]):
                near = [m[i + y, j + x] for y, x in kernel if 0 <= i + y < m.shape[0] and 0 <= j + x < m.shape[1]]
                out[i, j] = any(near) if any_ else all(near)
        return out

    for any_ in (False, True, True, False):
        mask = step(mask, any_)
    inside = [(i, j) for i in range(mask.shape[0]) for j in range(mask.shape[1]) if (i + y0 - cy) ** 2 + (j + x0 - cx) ** 2 <= r * r]
    return sum(mask[i, j] for i, j in inside) / len(inside)


def disc(page, cx, cy, r, shade, inner=-1):
    y, x = np.ogrid[: page.shape[0], : page.shape[1]]
    d = (x - cx) ** 2 + (y - cy) ** 2
    page[(d <= r * r) & (d > inner * abs(inner))] = shade


def test_bubble_masks_against_a_plain_version():
    rng = np.random.default_rng(3)
    page = np.full((120, 160), 240, np.uint8)
    disc(page, 30, 30, 8, 40)  # filled
    disc(page, 80, 30, 8, 40, inner=7)  # outline only
    disc(page, 130, 30, 8, 40)
    page[28:30, 124:137] = 240  # filled, with a thin gap
    speckled = page[50:110, 10:70]
    speckled[rng.random(speckled.shape) < 0.04] = 20  # specks around an empty bubble
    disc(page, 156, 116, 8, 30)  # at the page's corner
    cases = {(30, 30): (0.95, 1.01), (80, 30): (-0.01, 0.3), (130, 30): (0.8, 1.01), (40, 80): (-0.01, 0.12), (156, 116): (0.95, 1.01), (100, 90): (-0.01, 0.01), (500, 5): (-0.01, 0.01)}
    for (cx, cy), (low, high) in cases.items():
        got = L.fill_ratio(page, cx, cy, 8)
        assert got == pytest.approx(plain_ratio(page, cx, cy, 8)) and low < got < high, (cx, cy, got)
    noise = rng.integers(0, 256, (60, 60)).astype(np.uint8)
    for cx, cy, r in ((30, 30, 6), (2, 3, 5), (58, 30, 9), (30, 59, 2)):
        assert L.fill_ratio(noise, cx, cy, r) == pytest.approx(plain_ratio(noise, cx, cy, r))
    assert L.fill_ratio(np.zeros((9, 9), np.uint8), 4, 4, 2) == 1.0 and L.fill_ratio(np.full((9, 9), 90, np.uint8), 4, 4, 2) == 0.0
    assert L.ellipse(3).tolist() == [[-1, 0], [0, -1], [0, 0], [0, 1], [1, 0]]


class Echo:
    """Answers with a count of calls in a file for each prompt; odd ones fail at first, some for good."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, prompts, attempt):
        out = []
        for p in prompts:
            with open(f"{self.folder}/{p.replace(' ', '_')}", "a") as f:
                f.write("x")
            out.append(ValueError("bad key") if p.startswith("never") else RuntimeError("HTTP 429") if p.startswith("later") and attempt < 3 else TimeoutError("503 again") if p.startswith("down") else f" re: {p}\n")
        return out


def test_prompts_are_asked_once_and_failures_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = ["a", "a", "b", "later c", None, "never d", "down e", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string").repartition(3)
    got = {r.id: (r.reply, r.error, r.attempts) for r in C.ask(df, Echo(str(calls))).collect()}
    assert got == {0: ("re: a", None, 1), 1: ("re: a", None, 1), 2: ("re: b", None, 1), 3: ("re: later c", None, 3), 4: (None, None, None), 5: (None, "bad key", 1), 6: (None, "503 again", 3), 7: ("re: a", None, 1)}
    assert {f.name: f.stat().st_size for f in calls.iterdir()} == {"a": 1, "b": 1, "later_c": 3, "never_d": 1, "down_e": 3}
    assert C.ask(df.limit(0), Echo(str(calls))).count() == 0
    with pytest.raises(Exception, match="no language model is given"):
        C.ask(df).collect()
    with pytest.raises(Exception, match="replies to"):
        C.ask(df, lambda prompts, attempt: ["x"] * (len(prompts) + 1)).collect()


def test_a_failing_call_fails_its_batch_only(spark):
    def model(prompts, attempt):
        if attempt == 1:
            raise ConnectionError("rate limit")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"p{i % 7}") for i in range(40)], "id int, prompt string")
    assert {(r.prompt, r.reply, r.attempts) for r in C.ask(df, model, size=2).collect()} == {(f"p{i}", f"P{i}", 2) for i in range(7)}
