"""Curve matching: the subsequence of each series that is nearest to a query curve under dynamic time warping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY, col

#: Rows of a series that one task searches, and numbers that its normal forms take at a time.
CHUNK, CELLS = 1 << 14, 1 << 20


def normal(x: np.ndarray) -> np.ndarray:
    s = x.std()
    return (x - x.mean()) / s if s > 0 else x - x.mean()


def bounds(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower envelope of a curve within the band."""
    wide = np.pad(x, band, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(wide, 2 * band + 1)
    return view.max(axis=1), view.min(axis=1)


def dtw(a: np.ndarray, b: np.ndarray, band: int, best: float = np.inf) -> float:
    """Squared-cost DTW within a band; gives up once every path costs more than ``best``."""
    n = len(a)
    row = np.full(n, np.inf)
    for i in range(n):
        new = np.full(n, np.inf)
        lo, hi = max(0, i - band), min(n, i + band + 1)
        cost = (a[i] - b[lo:hi]) ** 2
        for j in range(lo, hi):
            if i == 0 and j == 0:
                before = 0.0
            else:
                before = min(row[j], row[j - 1] if j else np.inf, new[j - 1] if j else np.inf)
            new[j] = before + cost[j - lo]
        if new.min() > best:
            return np.inf
        row = new
    return float(row[-1])


def dtw_many(xs: np.ndarray, q: np.ndarray, band: int) -> np.ndarray:
    """Squared-cost DTW within a band of each row of ``xs`` and ``q``; the loops run over the curve, not over rows."""
    n = len(q)
    row = np.full((n, len(xs)), np.inf)
    for i in range(n):
        new = np.full((n, len(xs)), np.inf)
        for j in range(max(0, i - band), min(n, i + band + 1)):
            if i == 0 and j == 0:
                before = 0.0
            else:
                before = np.minimum(row[j], np.minimum(row[j - 1], new[j - 1])) if j else row[j]
            new[j] = before + (xs[:, i] - q[j]) ** 2
        row = new
    return row[-1]


def best_match(keys: np.ndarray, values: np.ndarray, curve: np.ndarray, band: int) -> tuple[int, float] | None:
    """(key where it starts, distance) of the best subsequence, the first of equal ones; LB_Kim and LB_Keogh leave out what can't be it."""
    n = len(curve)
    if len(values) < n:
        return None
    q = normal(curve)
    upper, lower = bounds(q, band)
    views = np.lib.stride_tricks.sliding_window_view(values, n)
    best, at = np.inf, None
    step = max(1, CELLS // n)
    for start in range(0, len(views), step):
        x = views[start : start + step]
        x = x - x.mean(axis=1, keepdims=True)
        s = x.std(axis=1, keepdims=True)
        x = x / np.where(s > 0, s, 1.0)
        # For a curve of one point its first and last cost are the same one.
        kim = (x[:, 0] - q[0]) ** 2 + ((x[:, -1] - q[-1]) ** 2 if n > 1 else 0.0)
        bound = np.maximum(kim, (np.maximum(0, np.maximum(x - upper, lower - x)) ** 2).sum(axis=1))
        order = np.argsort(bound, kind="stable")  # bounds that aren't numbers come last
        done, size = 0, 64
        while done < len(order):
            # Bounds are rounded otherwise than distances.
            some = order[done : done + size]
            some = np.sort(some[bound[some] <= best * (1 + 1e-9)])
            if not len(some):
                break
            d = dtw_many(x[some], q, band)
            d = np.where(np.isnan(d), np.inf, d)
            k = int(d.argmin())
            if d[k] < best or (d[k] == best and at is not None and start + some[k] < at):
                best, at = float(d[k]), start + int(some[k])
            done, size = done + size, min(2 * size, 4096)
    return (int(keys[at]), best) if at is not None else None


def curve_match(df: DataFrame, paths: list[str], curve: list[float], band: int = 5, chunk: int = CHUNK) -> DataFrame:
    """(path, key, distance): for each column the start of the subsequence nearest to the curve.

    Null values are left out.  The rows of a column are numbered in key order and cut into
    chunks, each with the next rows that its last subsequences reach into, so every
    subsequence lies whole in one chunk and no task holds a series.
    """
    q = np.asarray(curve, float)
    chunk = max(chunk, len(q))
    long = df.select(KEY, F.explode(F.array(*(F.struct(F.lit(p).alias("path"), col(p).cast("double").alias("value")) for p in paths))).alias("p")).select(KEY, "p.path", "p.value").where(F.col("value").isNotNull())
    cuts = key_cuts(df, chunk)
    bucketed = long.withColumn("bucket", F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col(KEY))) if cuts else F.lit(0))
    counted = bucketed.groupBy("path", "bucket").agg(F.count("*").alias("n"))
    # As many rows as ranges of each path, which the cuts bound.
    before = counted.select("path", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("path", "bucket").orderBy(KEY, "value"))
    placed = bucketed.withColumn("place", place).join(F.broadcast(before), ["path", "bucket"]).select("path", KEY, "value", (F.col("before") + F.col("place") - 1).alias("at"))
    own, within = F.floor(F.col("at") / chunk), F.col("at") % chunk
    chunks = F.when((within < len(q) - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    parts = placed.select("path", KEY, "value", "at", F.explode(chunks).alias("chunk"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        found = best_match(frame["at"].to_numpy(), frame["value"].to_numpy(), q, band)
        return pd.DataFrame([(frame["path"].iloc[0], found[0], int(frame[KEY].iloc[found[0] - frame["at"].iloc[0]]), found[1])] if found else [], columns=["path", "at", KEY, "distance"])

    found = parts.groupBy("path", "chunk").applyInPandas(run, f"path string, at long, {KEY} long, distance double")
    return found.groupBy("path").agg(F.min(F.struct("distance", "at", KEY)).alias("best")).select("path", f"best.{KEY}", "best.distance")


def key_cuts(df: DataFrame, per_range: int, most: int = 4096) -> list[int]:
    """Approximate quantiles of the key between ranges of about ``per_range`` rows; ``most`` cuts at most."""
    ranges = max(1, min(most, df.select(KEY).count() // per_range))
    if ranges == 1:
        return []
    found = df.select(F.percentile_approx(KEY, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    return sorted({int(c) for c in found or [] if c is not None})
