"""Causal features on streams: epochs by event time, sessions for contiguous runs, running state per participant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "n long, mean double, last_move double"
OUT = "client_id string, event_id long, t double, mean_so_far double, minutes_still double"


def epochs(stream: DataFrame, ts: str, width: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """count and mean of value in tumbling windows of each client; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy("client_id", F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("client_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def runs(stream: DataFrame, ts: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Contiguous runs of each client as session windows."""
    return stream.withWatermark(ts, late).groupBy("client_id", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("client_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, mean, last = state.get if state.exists else (0, 0.0, None)
    rows = pd.concat(list(batches)).sort_values(["t", "event_id"], kind="stable")
    out = []
    for event, t, value, bound in zip(rows["event_id"], rows["t"], rows["value"], rows["bound"], strict=True):
        n += 1
        mean += (value - mean) / n
        if value >= bound:
            last = t
        out.append((key[0], event, t, mean, min((t - last) / 60, 999.0) if last is not None else 999.0))
    state.update((n, mean, last))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def causal_features(stream: DataFrame) -> DataFrame:
    """stream (client_id, event_id, t, value, bound): running mean and minutes since value last reached bound.

    The state of a client is three numbers; within a micro-batch its rows are put in order of time.
    """
    return stream.groupBy("client_id").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")
