"""Frames over the test tables: events as recordings, lineitem as sensor axes, embeddings as client updates, labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import seconds

#: DuckDB views of the same frames.
EPOCHS_SQL = """epochs AS (SELECT 'EVENTS' AS dataset, 'EVENTS_' || user_id::VARCHAR AS client_id, event_id, epoch_us(ts) / 1e6 AS t,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS gappy, value, event_type,
  CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS y FROM events)"""
SCORED_SQL = """scored AS (SELECT d.doc_id, d.lang, d.source, l.quality AS y, 1 / (1 + exp(-(2 - n_chars / 2000.0 + (doc_id % 7) / 5.0))) AS p
  FROM documents d JOIN labels l USING (doc_id))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings of users: t in seconds, value, gappy (value with each seventh missing) and a label y."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("EVENTS").alias("dataset"),
        F.concat(F.lit("EVENTS_"), F.col("user_id").cast("string")).alias("client_id"),
        "event_id",
        seconds("ts").alias("t"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("gappy"),
        "value",
        "event_type",
        F.col("event_type").isin("purchase", "error").cast("int").alias("y"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a label y and a probability p made from their length."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    z = 2 - F.col("n_chars") / F.lit(2000.0) + (F.col("doc_id") % 7) / F.lit(5.0)
    return d.join(lab, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), (1 / (1 + F.exp(-z))).alias("p"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree."""
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])
