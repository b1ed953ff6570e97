"""Feature scaling fitted on some rows and applied to others, weights of participants and classes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, finite
from .stats import robust_scale


@dataclass
class RobustScaler:
    """Median and robust scale of each feature that varies in the fitted rows (two finite values, deviation of 1e-10)."""

    clip: float = 8.0
    features: list[str] = field(default_factory=list)
    median: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, candidates: list[str]) -> RobustScaler:
        aggs = []
        for c in candidates:
            x = finite(c)
            aggs += [F.count(x).alias(f"n|{c}"), F.stddev_pop(x).alias(f"s|{c}"), F.percentile(x, F.lit(0.5)).alias(f"m|{c}"), robust_scale(x, small=False).alias(f"r|{c}")]
        row = df.agg(*aggs).first()
        self.features = [c for c in sorted(candidates) if row[f"n|{c}"] >= 2 and row[f"s|{c}"] >= 1e-10]
        self.median = {c: row[f"m|{c}"] for c in self.features}
        self.scale = {c: row[f"r|{c}"] for c in self.features}
        return self

    @property
    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for c in self.features:
            out.setdefault(c.split("_")[0], []).append(c)
        return out

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep, z_{feature} (clipped, 0 where missing) and missing_{group}, the share of the group's features missing."""
        have = lambda c: finite(c) if c in df.columns else F.lit(None).cast("double")
        z = [F.coalesce(clip((have(c) - self.median[c]) / self.scale[c], -self.clip, self.clip), F.lit(0.0)).alias(f"z_{c}") for c in self.features]
        gone = [(sum((have(c).isNull().cast("int") for c in cs), F.lit(0)) / len(cs)).alias(f"missing_{g}") for g, cs in self.groups.items()]
        return df.select(*keep, *z, *gone)

    def available(self, df: DataFrame, key: str) -> DataFrame:
        """For each client, whether it has any finite value of each feature."""
        return df.groupBy(key).agg(*[(F.count(finite(c)) > 0).alias(f"has_{c}") for c in self.features])


def subject_weights(df: DataFrame, key: str) -> DataFrame:
    """df with weight: one over the client's rows, with mean 1 over all rows."""
    mine = 1 / F.count(F.lit(1)).over(Window.partitionBy(key))
    mean = df.agg((F.countDistinct(key) / F.count(F.lit(1))).alias("__mean"))  # one row
    return df.withColumn("__w", mine).crossJoin(F.broadcast(mean)).withColumn("weight", F.col("__w") / F.col("__mean")).drop("__w", "__mean")


def class_weights(df: DataFrame, power: float) -> DataFrame:
    """y and class_weight: (total / (2 mass)) ^ power, with mass-weighted mean 1, of rows with weight and y."""
    mass = df.groupBy("y").agg(F.sum("weight").alias("mass"))
    whole = Window.partitionBy(F.lit(0))  # a row for each of two classes
    raw = F.pow(F.sum("mass").over(whole) / (2 * F.col("mass")), F.lit(power))
    kept = mass.withColumn("__raw", raw)
    mean = F.sum(F.col("__raw") * F.col("mass")).over(whole) / F.sum("mass").over(whole)
    return kept.select("y", "mass", (F.col("__raw") / mean).alias("class_weight"))
