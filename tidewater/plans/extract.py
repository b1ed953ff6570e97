"""From raw recordings to epoch frames: one row per labelled window, with features of all its channels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, signal, stats
from ..sources.nested_signals import LABEL_RATE, window_samples

#: Sleep stages that count (0 is awake), and labels of the stress recordings (2 is stress).
STAGES, VALID_LABELS, STRESS = (0, 1, 2, 3, 5), (1, 2, 3), 2
EPOCH, CONTEXT, STEPS = 30.0, 120.0, 300.0
KEYS = ["client_id", "label_start"]
#: Fixed names of channels that differ from the recordings' own, and windows of a channel computed at once.
NAMES = {"BVP": "ppg"}
BLOCK = 32


def sleep_epochs(labels: DataFrame, align: str = "start", epoch: float = EPOCH) -> DataFrame:
    """labels (client_id, t, stage) as epochs; stages that do not count are left out. A label names the epoch that starts
    or ends at its time."""
    start = F.col("t") if align == "start" else F.col("t") - epoch
    kept = labels.filter(F.col("stage").isin(*STAGES))
    return kept.select("client_id", start.alias("label_start"), (start + epoch).alias("label_end"), (F.col("stage") != 0).cast("int").alias("y"))


def stage_counts(labels: DataFrame) -> DataFrame:
    """kept and excluded labels of each client."""
    good = F.coalesce(F.col("stage").isin(*STAGES), F.lit(False))
    return labels.groupBy("client_id").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("excluded"))


def valid_heart_rate(hr: DataFrame) -> DataFrame:
    return hr.filter((F.col("hr") > 0) & (F.col("hr") < F.lit(float("inf"))) & ~F.isnan("hr"))


def covered(epochs: DataFrame, motion: DataFrame, epoch: float = EPOCH) -> DataFrame:
    """Motion samples of the epochs with at least two samples that span 0.8 of the epoch."""
    met = joins.range_join(epochs, motion, "client_id", F.col("label_start"), F.col("label_end"), "t", epoch)
    good = met.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n"), (F.max("t") - F.min("t")).alias("__span")).filter((F.col("__n") >= 2) & (F.col("__span") >= 0.8 * epoch)).select(*KEYS)
    return met.join(good, KEYS, "left_semi")


def per_second(epochs: DataFrame, motion: DataFrame, prefix: str) -> DataFrame:
    """epochs with the slopes of motion, which are by sample, divided by the epoch's median time between samples."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*KEYS).orderBy("t"))
    step = motion.withColumn("__gap", gap).groupBy(*KEYS).agg(F.greatest(F.percentile("__gap", F.lit(0.5)), F.lit(1e-6)).alias("__step"))
    slopes = [c for c in epochs.columns if c.startswith(prefix) and c.endswith("_slope")]
    return epochs.join(step, KEYS).withColumns({c: F.col(c) / F.col("__step") for c in slopes}).drop("__step")


def sleep_frame(labels: DataFrame, motion: DataFrame, hr: DataFrame, steps: DataFrame | None = None, align: str = "start") -> DataFrame:
    """The epoch frame of sleep recordings: motion (t, x, y, z), hr (t, hr) and optional steps (t, n), by client_id.

    Epochs without enough motion are left out; other features are null where they have no samples, and feature_start is
    the start of the longest span that has any. Each kind of sample meets its windows by a binned join of its own; all
    then join on the epoch.
    """
    epochs = sleep_epochs(labels, align)
    spans = epochs.select(*KEYS, "label_end")
    axes = ["a0", "a1", "a2"]
    acc = covered(spans, motion.withColumnsRenamed(dict(zip("xyz", axes, strict=True))))
    parts = [per_second(stats.axis_stats(acc, KEYS, ["t"], axes, "acc_watch"), acc, "acc_watch")]
    mag = motion.withColumn("mag", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).select("client_id", "t", "mag")
    end = F.col("label_end")
    near = joins.range_join(spans, mag, "client_id", end - CONTEXT, end, "t", CONTEXT)
    parts.append(stats.basic_stats(near, KEYS, ["t"], "mag", "acc_context_mag"))
    beats = valid_heart_rate(hr)
    for name, lo in (("hr_epoch", F.col("label_start")), ("hr_context", end - CONTEXT)):
        parts.append(stats.basic_stats(joins.range_join(spans, beats, "client_id", lo, end, "t", CONTEXT), KEYS, ["t"], "hr", name))
    begin = F.when(F.coalesce("acc_context_mag_n", "hr_context_n").isNotNull(), end - CONTEXT).otherwise(F.col("label_start"))
    if steps is not None:
        inside = joins.complete_bins(steps, spans, "client_id", ["t"], "t", end - STEPS, end, STEPS)
        parts.append(stats.basic_stats(inside, KEYS, ["t"], "n", "steps_complete"))
        begin = F.when(F.col("steps_complete_n").isNotNull(), end - STEPS).otherwise(begin)
    base = epochs.join(parts[0], KEYS)
    wide = reduce(lambda a, b: a.join(b, KEYS, "left"), parts[1:], base)
    fixed = {"dataset": F.lit("SLEEP"), "task": F.lit("sleep"), "feature_start": begin, "feature_end": end, "label_coverage": F.lit(1.0), "label_purity": F.lit(1.0), "declared_lookahead_s": F.lit(0.0)}
    return wide.select(*[c.alias(n) for n, c in fixed.items()], *wide.columns)


def _plain_stats(x: np.ndarray, prefix: str, dt: float) -> dict[str, float]:
    x = x[np.isfinite(x)]
    if not len(x):
        return {}
    p10, p25, med, p75, p90 = np.percentile(x, [10, 25, 50, 75, 90])
    t = np.arange(len(x)) * dt
    slope = ((t - t.mean()) * (x - x.mean())).sum() / max(((t - t.mean()) ** 2).sum(), 1e-12)
    values = (x.mean(), x.std(), med, p75 - p25, p10, p90, np.median(np.abs(x - med)), np.sqrt((x**2).mean()), slope, np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0, float(len(x)))
    return {f"{prefix}_{n}": float(v) for n, v in zip(("mean", "std", "median", "iqr", "p10", "p90", "mad", "rms", "slope", "dmean", "n"), values, strict=True)}


def _channel_rows(part: pd.DataFrame) -> pd.DataFrame:
    """client_id, win, feature and value of some windows of one channel."""
    part = part.sort_values(["win", "idx"], kind="stable")
    device, channel, fs = part["device"].iloc[0], part["channel"].iloc[0], float(part["fs"].iloc[0])
    kind = NAMES.get(channel, channel.lower())
    prefix, tables = f"{kind}_{device}", []
    windows = {win: np.array(own["v"].tolist(), dtype=float) for win, own in part.groupby("win", sort=True)}
    for size in sorted({len(x) for x in windows.values()}):
        some = {win: x for win, x in windows.items() if len(x) == size}
        beyond = [{}] * len(some) if kind == "acc" else signal.channel_table(np.array([x[:, 0] for x in some.values()]), fs, kind)
        for (win, x), more in zip(some.items(), beyond, strict=True):
            if kind == "acc":
                length = np.sqrt((x[:, :3] ** 2).sum(1))
                got = _plain_stats(length, f"{prefix}_mag", 1 / fs) | {f"{prefix}_activity": float(np.abs(length - np.median(length)).mean())}
                for k in range(3):
                    got |= _plain_stats(x[:, k], f"{prefix}_a{k}", 1 / fs)
            else:
                got = _plain_stats(x[:, 0], prefix, 1 / fs) | {f"{prefix}_{n}": v for n, v in more.items()}
            tables.append(pd.DataFrame({"win": win, "feature": list(got), "value": list(got.values())}))
    return pd.concat(tables).assign(client_id=part["client_id"].iloc[0])[["client_id", "win", "feature", "value"]]


def channel_features(windowed: DataFrame) -> DataFrame:
    """client_id, win, feature, value of each channel of each window: basic statistics, and spectra and beats by kind."""
    blocks = windowed.withColumn("__block", F.floor(F.col("win") / BLOCK))
    return blocks.groupBy("client_id", "device", "channel", "__block").applyInPandas(_channel_rows, "client_id string, win long, feature string, value double")


def column_name(feature: str) -> str:
    """A feature's name as a column: the points of band limits become p, as a point would need quoting everywhere."""
    return feature.replace(".", "p")


def stress_frame(samples: DataFrame, labels: DataFrame, width: float = 60.0, stride: float = 30.0, amusement: bool = True) -> DataFrame:
    """The epoch frame of multi-rate recordings: full windows whose labels pass the gate, features pivoted to columns.

    Channels are aligned by window, so a missing or short channel leaves nulls, not a missing row. Without amusement, its
    label (3) does not count as valid. Columns are named by column_name().
    """
    as_channel = labels.select("client_id", F.lit("label").alias("device"), F.lit("label").alias("channel"), F.lit(LABEL_RATE).alias("fs"), "idx", "label")
    gate = joins.label_gate(window_samples(as_channel, width, stride), ["client_id", "win"], "label", list(VALID_LABELS if amusement else VALID_LABELS[:2])).filter("label is not null")
    long = channel_features(window_samples(samples, width, stride)).withColumn("feature", F.replace("feature", F.lit("."), F.lit("p")))
    wide = long.groupBy("client_id", "win").pivot("feature").agg(F.first("value"))
    start = F.col("win") * stride
    met = gate.withColumnRenamed("coverage", "label_coverage").withColumnRenamed("purity", "label_purity").join(wide, ["client_id", "win"])
    names = [c for c in wide.columns if c not in ("client_id", "win")]
    return met.select(F.lit("WESAD").alias("dataset"), F.lit("stress").alias("task"), "client_id", (F.col("label") == STRESS).cast("int").alias("y"), start.alias("feature_start"), (start + width).alias("feature_end"), start.alias("label_start"), (start + width).alias("label_end"), "label_coverage", "label_purity", F.lit(0.0).alias("declared_lookahead_s"), *names)
