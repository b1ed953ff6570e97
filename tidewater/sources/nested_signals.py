"""Nested multi-rate recordings (device, channel, samples) as long tables.

Pickles are converted once, on the driver, by a reader that admits arrays and plain containers only; executors read
Parquet.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed sampling rates of channels, by device.
RATES = {("wrist", "ACC"): 32.0, ("wrist", "BVP"): 64.0, ("wrist", "EDA"): 4.0, ("wrist", "TEMP"): 4.0, **{("chest", c): 700.0 for c in ("ACC", "ECG", "EDA", "EMG", "Resp", "Temp")}}
LABEL_RATE = 700.0
_SAFE = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("_codecs", "encode")}


class _Reader(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in _SAFE:
            raise pickle.UnpicklingError(f"not admitted: {module}.{name}")
        return super().find_class(module, name)


def load_nested(data: bytes) -> dict:
    return _Reader(io.BytesIO(data), encoding="latin1").load()


def sample_rows(client: str, nested: dict, wrist_only: bool = False) -> Iterator[tuple]:
    """(client_id, device, channel, fs, idx, v) of each sample of the known channels; several axes are one array.

    A chest temperature named TEMP stands for Temp where there is no Temp.
    """
    for (device, channel), fs in RATES.items():
        if wrist_only and device != "wrist":
            continue
        own = nested["signal"].get(device, {})
        values = own.get(channel, own.get("TEMP") if channel == "Temp" else None)
        if values is not None:
            a = np.asarray(values, dtype=float)
            for i, row in enumerate(a.reshape(len(a), -1)):
                yield client, device, channel, fs, i, row.tolist()


SAMPLES = "client_id string, device string, channel string, fs double, idx long, v array<double>"


def to_tables(spark: SparkSession, recordings: dict[str, dict], wrist_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """samples and labels (client_id, idx, label) of a few recordings held by the driver; write them as Parquet once."""
    samples = spark.createDataFrame([r for c, n in recordings.items() for r in sample_rows(c, n, wrist_only)], SAMPLES)
    labels = spark.createDataFrame([(c, i, int(x)) for c, n in recordings.items() for i, x in enumerate(np.asarray(n["label"]).ravel())], "client_id string, idx long, label int")
    return samples, labels


def read_nested(spark: SparkSession, paths: list[str], wrist_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """samples and labels of pickled recordings, a file per client, read by executors; clients are named by their files."""
    files = spark.read.format("binaryFile").load(paths).select(F.concat(F.lit("WESAD_"), F.regexp_extract("path", r"([^/]+)\.pkl$", 1)).alias("client_id"), "content").repartition(len(paths))
    names = [x.split()[0] for x in SAMPLES.split(", ")]

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for client, data in zip(part["client_id"], part["content"], strict=True):
                rows = sample_rows(client, load_nested(data), wrist_only)
                while some := list(islice(rows, 50_000)):
                    yield pd.DataFrame(some, columns=names)

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for client, data in zip(part["client_id"], part["content"], strict=True):
                label = np.asarray(load_nested(data)["label"]).ravel().astype("int32")
                yield pd.DataFrame({"client_id": client, "idx": np.arange(len(label)), "label": label})

    return files.mapInPandas(samples, SAMPLES), files.mapInPandas(labels, "client_id string, idx long, label int")


def window_samples(samples: DataFrame, width: float, stride: float) -> DataFrame:
    """samples with win, for each full window of width seconds by stride that holds them; index bounds are rounded, and
    channels with less than 0.9 of a window's samples are left out of it."""
    length = samples.groupBy("client_id").agg(F.min(F.col("n") / F.col("fs")).alias("s")) if "n" in samples.columns else samples.groupBy("client_id", "device", "channel", "fs").agg((F.max("idx") + 1).alias("n")).groupBy("client_id").agg(F.max(F.col("n") / F.col("fs")).alias("s"))
    wins = length.filter(F.col("s") >= width).select("client_id", F.floor((F.col("s") - width) / stride).alias("__last"))
    t = F.col("idx") / F.col("fs")
    first = F.greatest(F.lit(0).cast("long"), F.floor((t - width) / stride))
    many = samples.join(wins, "client_id").withColumn("win", F.explode(F.sequence(first, F.greatest(first, F.least(F.col("__last"), F.floor(t / stride) + 1)))))
    lo, hi = F.rint(F.col("win") * stride * F.col("fs")), F.rint((F.col("win") * stride + width) * F.col("fs"))
    inside = many.filter((F.col("win") <= F.col("__last")) & (F.col("idx") >= lo) & (F.col("idx") < hi)).drop("__last")
    whole = inside.groupBy("client_id", "device", "channel", "win").agg((F.count(F.lit(1)) >= 0.9 * width * F.first("fs")).alias("__ok")).filter("__ok").drop("__ok")
    return inside.join(whole, ["client_id", "device", "channel", "win"], "left_semi")
