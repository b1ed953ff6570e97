"""Order statistics of groups: the eleven basic statistics, robust scales, resampled means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite, named_int


def _stats(df: DataFrame, keys: list[str], order: list[str], prefixes: dict[str, str], dt: float) -> DataFrame:
    """The eleven statistics of several columns, each over its own finite values, by one sort and one aggregation."""
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(*order)
    up_to, before = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"__x_{p}": finite(c) for c, p in prefixes.items()})
    seen, out, picked = {}, [], {}
    for p in prefixes.values():
        x = F.col(f"__x_{p}")
        seen |= {f"__i_{p}": F.count(x).over(up_to) - 1, f"__d_{p}": F.abs(x - F.last(x, ignorenulls=True).over(before)), f"__m_{p}": F.percentile(x, F.lit(0.5)).over(whole)}
        out += [
            F.avg(x).alias(f"{p}_mean"),
            F.stddev_pop(x).alias(f"{p}_std"),
            F.percentile(x, F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias(f"__q_{p}"),
            F.median(F.abs(x - F.col(f"__m_{p}"))).alias(f"{p}_mad"),
            F.sqrt(F.avg(x * x)).alias(f"{p}_rms"),
            F.coalesce(F.regr_slope(x, F.col(f"__i_{p}") * F.lit(dt)), F.lit(0.0)).alias(f"{p}_slope"),
            F.coalesce(F.avg(f"__d_{p}"), F.lit(0.0)).alias(f"{p}_dmean"),
            F.count(x).alias(f"{p}_n"),
        ]
        at = lambda k, p=p: F.get(f"__q_{p}", F.lit(k))
        picked |= {f"{p}_p10": at(0), f"{p}_median": at(2), f"{p}_p90": at(4), f"{p}_iqr": at(3) - at(1)}
    agg = rows.withColumns(seen).groupBy(*keys).agg(*out).withColumns(picked)
    return agg.drop(*[f"__q_{p}" for p in prefixes.values()])


def basic_stats(df: DataFrame, keys: list[str], order: list[str], value: str, prefix: str, dt: float = 1.0) -> DataFrame:
    """mean, std, median, iqr, p10, p90, mad, rms, slope, dmean and n of the finite values of each group.

    The slope is by position times dt after non-finite values are left out; a group of one has slope and dmean 0; a
    group without finite values gives no row. One shuffle by the keys: window and aggregates share it.
    """
    return _stats(df.filter(finite(value).isNotNull()), keys, order, {value: prefix}, dt)


def axis_stats(df: DataFrame, keys: list[str], order: list[str], axes: list[str], prefix: str) -> DataFrame:
    """basic_stats of each axis and of the magnitude, and activity, the mean distance of the magnitude to its median; for
    groups in which each has finite values. One shuffle."""
    square = sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))
    rows = df.withColumn("__mag", F.sqrt(square))
    distance = F.abs(F.col("__mag") - F.percentile("__mag", F.lit(0.5)).over(Window.partitionBy(*keys)))
    prefixes = {"__mag": f"{prefix}_mag"} | {a: f"{prefix}_{a}" for a in axes}
    out = _stats(rows.withColumn("__far", distance), keys, order, prefixes | {"__far": "__far"}, 1.0)
    full = F.least(*[F.col(f"{p}_n") for p in prefixes.values()]) > 0
    return out.filter(full).withColumnRenamed("__far_mean", f"{prefix}_activity").drop(*[c for c in out.columns if c.startswith("__far") and c != "__far_mean"])


def robust_scale(x: Column, small: bool = True) -> Column:
    """The larger of IQR / 1.349, a twentieth of the standard deviation and 1e-6; with small, 1 for fewer than 4 values."""
    p = lambda q: F.percentile(x, F.lit(q))
    scale = F.greatest((p(0.75) - p(0.25)) / 1.349, F.stddev_pop(x) * 0.05, F.lit(1e-6))
    return F.when(F.count(x) >= 4, scale).otherwise(1.0) if small else scale


def bootstrap_mean(df: DataFrame, keys: list[str], unit: str, value: str, reps: int, seed: int = 0, least: int = 6) -> DataFrame:
    """Mean and the 2.5 and 97.5 percent quantiles of reps resampled means of each group; null below least values.

    Draws come from named hashes, so they are the same everywhere. A group's draws are dealt by replicate, as rows.
    """
    numbered = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"), (F.row_number().over(Window.partitionBy(*keys).orderBy(unit)) - 1).alias("__i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__n"))
    draws = numbered.select(*keys, "__n", F.col("__i").alias("__slot")).withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("__i", named_int(1 << 30, seed, F.col("__rep"), F.col("__slot")) % F.col("__n"))
    means = draws.join(numbered.select(*keys, "__i", "__x"), [*keys, "__i"]).groupBy(*keys, "__rep").agg(F.avg("__x").alias("__m"))
    bounds = means.groupBy(*keys).agg(F.percentile("__m", F.lit(0.025)).alias("ci_low"), F.percentile("__m", F.lit(0.975)).alias("ci_high"))
    whole = numbered.groupBy(*keys).agg(F.avg("__x").alias("mean"), F.count("__x").alias("n"))
    enough = F.col("n") >= max(2, least)
    return whole.join(bounds, keys).select(*keys, "mean", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("ci_low", "ci_high")])
