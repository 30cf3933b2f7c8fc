"""Where a page's regions are on its scan: a projective map from marker corners, robust against wrong ones.

Finding the markers in pixels is the scanner's part; their corners are input columns. The map of each page is fitted in
Arrow batches, a page at a time; regions go through it as column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fewest markers, greatest distance of an inlier in pixels; tilts that are corrected, in degrees.
LEAST_MARKERS, REACH, LEAST_TILT, MOST_TILT = 2, 5.0, 0.5, 15.0
#: Tries of four corners each; their seed.
TRIES, SEED = 400, 7


def _fit(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 map that takes points p to q best in its equations (each set moved and scaled first); None if they
    don't tell one."""

    def frame(x):
        m = x.mean(0)
        s = np.sqrt(2) / max(1e-12, np.sqrt(((x - m) ** 2).sum(1)).mean())
        return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])

    a, b = frame(p), frame(q)
    x, y = (np.c_[z, np.ones(len(z))] @ f.T for z, f in ((p, a), (q, b)))
    zero = np.zeros_like(x)
    rows = np.vstack([np.hstack([x, zero, -y[:, :1] * x]), np.hstack([zero, x, -y[:, 1:2] * x])])
    _, s, v = np.linalg.svd(rows)
    if len(s) < 8 or s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.inv(b) @ v[-1].reshape(3, 3) @ a
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def _distances(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    z = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.hypot(*(z[:, :2] / z[:, 2:] - q).T), nan=np.inf)


def robust_map(p: np.ndarray, q: np.ndarray, reach: float = REACH) -> tuple[np.ndarray, np.ndarray] | None:
    """(map, inliers): of maps through four corners the one that brings most corners within reach, fitted anew to those
    until they stay the same. The same corners give the same map."""
    n = len(p)
    if n < 4:
        return None
    rng, best, most = np.random.default_rng(SEED), None, 0
    for _ in range(TRIES):
        at = rng.choice(n, 4, replace=False)
        h = _fit(p[at], q[at])
        if h is None:
            continue
        ok = _distances(h, p, q) <= reach
        if ok.sum() > most:
            best, most = ok, int(ok.sum())
            if most == n:
                break
    for _ in range(10):
        h = _fit(p[best], q[best]) if best is not None and best.sum() >= 4 else None
        if h is None:
            return None
        ok = _distances(h, p, q) <= reach
        if (ok == best).all() or ok.sum() < 4:
            return h, best
        best = ok
    return h, best


def page_maps(corners: DataFrame, template: DataFrame) -> DataFrame:
    """(page_id, markers, n_corners, inliers, h): the map from scan to template pixels of each page, h as nine numbers by
    rows. corners (page_id, marker_id, corner, x, y) are those found, template (marker_id, corner, x, y) where they
    belong; markers that the template lacks don't count, nor do corners without a place. Pages of fewer than two known
    markers, or whose corners agree on no map, have a null h."""
    t = template.select("marker_id", "corner", F.col("x").alias("tx"), F.col("y").alias("ty"))
    known = corners.where("x is not null and y is not null").join(t, ["marker_id", "corner"])
    point = F.struct("marker_id", "corner", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("tx").cast("double").alias("tx"), F.col("ty").cast("double").alias("ty"))
    pages = known.groupBy("page_id").agg(F.sort_array(F.collect_list(point)).alias("p"), F.count_distinct("marker_id").cast("int").alias("markers"))
    pages = corners.select("page_id").distinct().join(pages, "page_id", "left").select("page_id", F.coalesce("markers", F.lit(0)).alias("markers"), *[F.col(f"p.{c}").alias(c) for c in ("x", "y", "tx", "ty")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, inliers, maps = [], [], []
            for markers, x, y, tx, ty in zip(*(batch.column(c).to_pylist() for c in ("markers", "x", "y", "tx", "ty")), strict=True):
                got = robust_map(np.c_[x, y], np.c_[tx, ty]) if markers >= LEAST_MARKERS else None
                n.append(len(x or ()))
                inliers.append(0 if got is None else int(got[1].sum()))
                maps.append(None if got is None else got[0].ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("markers"), pa.array(n, pa.int32()), pa.array(inliers, pa.int32()), pa.array(maps, pa.list_(pa.float64()))], ["page_id", "markers", "n_corners", "inliers", "h"])

    return pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, markers int, n_corners int, inliers int, h array<double>")


def mapped(h: Column, x: Column, y: Column) -> Column:
    """struct(x, y): a point through a map of nine numbers; null at its horizon."""
    at = lambda i: F.get(h, F.lit(i))
    below = at(6) * x + at(7) * y + at(8)
    return F.struct(F.try_divide(at(0) * x + at(1) * y + at(2), below).alias("x"), F.try_divide(at(3) * x + at(4) * y + at(5), below).alias("y"))


def inverse(h: Column) -> Column:
    """The map back, up to a factor."""
    a = [F.get(h, F.lit(i)) for i in range(9)]
    two = lambda i, j, k, m: a[i] * a[j] - a[k] * a[m]
    return F.array(two(4, 8, 5, 7), two(2, 7, 1, 8), two(1, 5, 2, 4), two(5, 6, 3, 8), two(0, 8, 2, 6), two(2, 3, 0, 5), two(3, 7, 4, 6), two(1, 6, 0, 7), two(0, 4, 1, 3))


def tilt(thetas: Column) -> Column:
    """Degrees by which a page is turned, from the angles of lines found on it (array<double>, radians): the median of
    those nearer to level than 45 degrees; 0 where it is too small to matter or too large to be believed, or there is
    none."""
    degrees = F.array_sort(F.filter(F.transform(thetas, lambda t: F.degrees(t - F.pi() / 2)), lambda d: F.abs(d) < 45))
    n = F.size(degrees)
    middle = (F.get(degrees, F.floor((n - 1) / 2).cast("int")) + F.get(degrees, F.floor(n / 2).cast("int"))) / 2
    return F.when((n > 0) & (F.abs(middle) >= LEAST_TILT) & (F.abs(middle) <= MOST_TILT), middle).otherwise(0.0)
