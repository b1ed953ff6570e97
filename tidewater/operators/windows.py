"""Sequence operators over recordings: runs, rolling frames, ranks, gap filling, elapsed time.

All of them partition by recording (and run) and order by time and a tie-breaking key, so that a chain of them costs
one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import robust_scale

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def contiguous_runs(df: DataFrame, key: str, t: str, tie: str, ratio: float = 1.75) -> DataFrame:
    """df with step (the median time step of the recording, 1 if there is none) and run (from 0; broken by gaps over ratio steps)."""
    by = Window.partitionBy(key)
    order = by.orderBy(t, tie)
    gaps = df.withColumn("__dt", F.col(t) - F.lag(t).over(order))
    stepped = gaps.withColumn("step", F.coalesce(F.percentile("__dt", F.lit(0.5)).over(by), F.lit(1.0)))
    broken = F.when(F.col("__dt") > ratio * F.col("step"), 1).otherwise(0)
    return stepped.withColumn("run", F.sum(broken).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__dt")


def frame(kind: str, w: int) -> tuple[int, int]:
    """Rows before and after for a rolling frame of w rows: centered (the later half one longer), trailing or forward."""
    ahead = (w - 1) // 2
    return {"centered": (ahead - (w - 1), ahead), "trailing": (1 - w, 0), "forward": (0, w - 1)}[kind]


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, widths: list[int], kind: str) -> DataFrame:
    """df with {value}_{kind}_{mean,std}_{w}: of at least one row, with the population standard deviation."""
    cols: dict[str, Column] = {}
    for w in widths:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame(kind, w))
        cols[f"{value}_{kind}_mean_{w}"] = F.avg(value).over(over)
        cols[f"{value}_{kind}_std_{w}"] = F.stddev_pop(value).over(over)
    return df.withColumns(cols)


def context_features(df: DataFrame, key: str, order: list[str], value: str, widths: list[int], centered: bool = True, forward: bool = True) -> DataFrame:
    """df (with run) with, for each width: cm, cs, dev (centered or trailing), bm, fm and asym; all relative to the
    recording's median and robust scale."""
    whole = Window.partitionBy(key)
    rows = df.withColumns({"__med": F.percentile(value, F.lit(0.5)).over(whole), "__scl": _scale_over(F.col(value), whole)})
    mean = lambda kind, w: F.avg(value).over(Window.partitionBy(key, "run").orderBy(*order).rowsBetween(*frame(kind, w)))
    std = lambda kind, w: F.stddev_pop(value).over(Window.partitionBy(key, "run").orderBy(*order).rowsBetween(*frame(kind, w)))
    main, cols = "centered" if centered else "trailing", {}
    for w in widths:
        cols[f"{value}_cm_{w}"] = (mean(main, w) - F.col("__med")) / F.col("__scl")
        cols[f"{value}_cs_{w}"] = std(main, w) / F.col("__scl")
        cols[f"{value}_dev_{w}"] = (F.col(value) - mean(main, w)) / F.col("__scl")
        cols[f"{value}_bm_{w}"] = (mean("trailing", w) - F.col("__med")) / F.col("__scl")
        if forward:
            cols[f"{value}_fm_{w}"] = (mean("forward", w) - F.col("__med")) / F.col("__scl")
            cols[f"{value}_asym_{w}"] = (mean("forward", w) - mean("trailing", w)) / F.col("__scl")
    return rows.withColumns(cols).drop("__med", "__scl")


def _scale_over(x: Column, by) -> Column:
    p = lambda q: F.percentile(x, F.lit(q)).over(by)
    return F.when(F.count(x).over(by) >= 4, F.greatest((p(0.75) - p(0.25)) / 1.349, F.stddev_pop(x).over(by) * 0.05, F.lit(1e-6))).otherwise(1.0)


def subject_ranks(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with {value}_z, robust, and {value}_pct: average rank of ties over the number of values, less one half."""
    by = Window.partitionBy(key)
    ties = F.count(value).over(Window.partitionBy(key, value))
    rank = F.rank().over(by.orderBy(F.col(value).asc_nulls_last())) + (ties - 1) / 2
    z = (F.col(value) - F.percentile(value, F.lit(0.5)).over(by)) / _scale_over(F.col(value), by)
    return df.withColumns({f"{value}_z": z, f"{value}_pct": F.when(F.col(value).isNotNull(), rank / F.count(value).over(by) - 0.5)})


def activity(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.withColumn("activity", F.greatest(F.col(value) - F.percentile(value, F.lit(0.5)).over(Window.partitionBy(key)), F.lit(0.0)))


def since_movement(df: DataFrame, key: str, t: str, tie: str) -> DataFrame:
    """df (with activity) with activity_so_far and minutes since the activity last reached its upper quartile (at most
    999, which is also the value before the first time; never reached by recordings of three rows or fewer)."""
    by = Window.partitionBy(key)
    so_far = by.orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    bound = F.when(F.count("activity").over(by) > 3, F.percentile("activity", F.lit(0.75)).over(by))
    rows = df.withColumn("__bound", bound)
    last = F.last(F.when(F.col("activity") >= F.col("__bound"), F.col(t)), ignorenulls=True).over(so_far)
    return rows.withColumns({"activity_so_far": F.avg("activity").over(so_far), "minutes_still": F.least(F.coalesce((F.col(t) - last) / 60, F.lit(999.0)), F.lit(999.0))}).drop("__bound")


def elapsed(df: DataFrame, key: str, t: str) -> DataFrame:
    minutes = (F.col(t) - F.min(t).over(Window.partitionBy(key))) / 60
    return df.withColumns({"elapsed_min": minutes, "elapsed_log": F.log1p(minutes)})


def retrospective(df: DataFrame, key: str, t: str, tie: str) -> DataFrame:
    """df (with activity) with the place in the whole recording: frac, remaining minutes, its cosine and sine, and the
    share of all activity that has passed."""
    by = Window.partitionBy(key)
    first, last = F.min(t).over(by), F.max(t).over(by)
    frac = (F.col(t) - first) / F.greatest(last - first, F.lit(1e-9))
    passed = F.sum("activity").over(by.orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(F.sum("activity").over(by), F.lit(1e-9))
    return df.withColumns({"frac": frac, "remaining_min": (last - F.col(t)) / 60, "frac_cos": F.cos(frac * F.lit(6.283185307179586)), "frac_sin": F.sin(frac * F.lit(6.283185307179586)), "activity_passed": passed})


def interpolate(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with {value}_filled: gaps filled linearly by row position, flat at the edges, null if all is missing."""
    by = Window.partitionBy(key).orderBy(*order)
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    at = df.withColumn("__i", F.row_number().over(by))
    known = F.when(F.col(value).isNotNull(), F.col("__i"))
    v0, v1 = F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead)
    i0, i1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    line = v0 + (v1 - v0) * (F.col("__i") - i0) / F.when(i1 > i0, i1 - i0).otherwise(1)
    return at.withColumn(f"{value}_filled", F.coalesce(line, v0, v1)).drop("__i")


def lookahead(df: DataFrame, widths: list[int], centered: bool, forward: bool) -> DataFrame:
    """df (with step and feature_start, feature_end) widened by what context features read, and declared_lookahead_s.

    A forward frame of w rows reaches w - 1 steps ahead and a centered one half of that, which is what is declared.
    """
    w = max(widths)
    reach = (w - 1) if forward else (w - 1) // 2 if centered else 0
    ahead = F.col("step") * reach
    return df.withColumns({"feature_start": F.col("feature_start") - F.col("step") * (w - 1), "feature_end": F.col("feature_end") + ahead, "declared_lookahead_s": ahead})


def scale_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(robust_scale(F.col(value)).alias("scale"))
