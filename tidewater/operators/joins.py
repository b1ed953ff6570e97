"""Joins of intervals and samples: binned range joins, containment, overlap, label gates, support and query rows.

Open-source Spark has no range join operator: equality on the recording with a range residual is quadratic in a
recording. Here both sides are cut into bins as long as the interval's unit and joined by recording and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(intervals: DataFrame, samples: DataFrame, key: str, start: Column, stop: Column, t: str, bin_s: float, closed: bool = False) -> DataFrame:
    """Pairs of intervals and samples of one key with start <= t < stop (closed: <= stop)."""
    bins = F.sequence(F.floor(start / bin_s), F.floor(stop / bin_s))
    cut = intervals.withColumns({"__lo": start, "__hi": stop}).withColumn("__bin", F.explode(bins))
    dealt = samples.withColumn("__bin", F.floor(F.col(t) / bin_s))
    inside = (F.col(t) >= F.col("__lo")) & ((F.col(t) <= F.col("__hi")) if closed else (F.col(t) < F.col("__hi")))
    return cut.join(dealt, [key, "__bin"]).filter(inside).drop("__bin", "__lo", "__hi")


def sliding_windows(samples: DataFrame, key: str, t: str, width: float, stride: float) -> DataFrame:
    """key, start, stop of the full windows of each recording, from its first sample on."""
    span = samples.groupBy(key).agg(F.min(t).alias("__first"), F.max(t).alias("__last"))
    count = F.floor((F.col("__last") - F.col("__first") - width) / stride)
    starts = span.filter(count >= 0).select(key, "__first", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("win"))
    return starts.select(key, "win", (F.col("__first") + F.col("win") * stride).alias("start"), (F.col("__first") + F.col("win") * stride + width).alias("stop"))


def complete_bins(samples: DataFrame, intervals: DataFrame, key: str, order: list[str], t: str, start: Column, stop: Column, bin_s: float) -> DataFrame:
    """Samples that hold a bin up to the next sample, wholly inside [start, stop]; the last one's end is unknown."""
    ends = samples.withColumn("t_next", F.lead(t).over(Window.partitionBy(key).orderBy(*order))).filter(F.col("t_next") > F.col(t))
    met = range_join(intervals, ends, key, start, stop, t, bin_s, closed=True)
    return met.filter(F.col("t_next") <= stop)


def label_gate(df: DataFrame, keys: list[str], label: str, valid: list, coverage: float = 0.95, purity: float = 0.95) -> DataFrame:
    """For each group the dominant valid label (ties: the smallest) if valid labels and it reach their shares of all
    labels, else null; with coverage and purity."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    good = F.col(label).isin(*valid)
    most = F.min_by(F.when(good, F.col(label)), F.when(good, F.struct((-F.col("__n")).alias("n"), F.col(label).alias("l"))))
    out = counts.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum(F.when(good, F.col("__n")).otherwise(0)).alias("__valid"), F.max(F.when(good, F.col("__n"))).alias("__top"), most.alias("__label"))
    shares = out.withColumns({"coverage": F.col("__valid") / F.col("n"), "purity": F.coalesce(F.col("__top"), F.lit(0)) / F.col("n")})
    return shares.withColumn("label", F.when((F.col("coverage") >= coverage) & (F.col("purity") >= purity), F.col("__label"))).drop("__valid", "__top", "__label")


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of rows of a and b (key, lo, hi) of one key whose open intervals meet: none where both are disjoint in time.

    Both sides are cut into bins; a pair is kept in the bin where the later of the two starts, so once. A key's bins are
    as long as its intervals on average, so there are at most three times as many pieces as rows, whatever the lengths.
    """
    both = a.select(key, "lo", "hi").unionByName(b.select(key, "lo", "hi"))
    widths = both.groupBy(key).agg(F.avg(F.abs(F.col("hi") - F.col("lo"))).alias("__w")).withColumn("__w", F.when(F.col("__w") > 0, F.col("__w")).otherwise(1.0))
    bins = F.explode(F.sequence(F.floor(F.col("lo") / F.col("__w")), F.floor(F.col("hi") / F.col("__w"))))
    # merge: cut rows are many more than the planner takes them for, so they would be sent through the driver
    x, y = (d.join(widths.hint("merge"), key).withColumn("__bin", bins).alias(k) for d, k in ((a, "a"), (b, "b")))
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__bin") == F.col("b.__bin"))
    met = x.join(y.hint("merge"), same & (F.col("a.lo") < F.col("b.hi")) & (F.col("a.hi") > F.col("b.lo")))
    return met.filter(F.col("a.__bin") == F.floor(F.greatest("a.lo", "b.lo") / F.col("a.__w"))).drop(F.col("a.__bin"), F.col("b.__bin"), F.col("a.__w"), F.col("b.__w"))


def support_query(df: DataFrame, key: str, order: list[str], shots: int) -> DataFrame:
    """df with part: support for the first min(shots, a third) rows of a recording of five rows or more, query for rows
    that start when all support has ended, null for the rest."""
    by = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(by)
    take = F.when(n < 5, 0).otherwise(F.least(F.lit(shots), F.floor(n / 3)))
    rows = df.withColumns({"__rn": F.row_number().over(by.orderBy(*order)), "__k": take})
    ended = F.max(F.when(F.col("__rn") <= F.col("__k"), F.greatest("feature_end", "label_end"))).over(by)
    rows = rows.withColumn("__end", ended)
    later = (F.col("feature_start") >= F.col("__end")) & (F.col("label_start") >= F.col("__end"))
    return rows.withColumn("part", F.when(F.col("__rn") <= F.col("__k"), "support").when(F.col("__end").isNull() | later, "query")).drop("__rn", "__k", "__end")
