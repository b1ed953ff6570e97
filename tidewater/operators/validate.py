"""Checks of epoch frames and splits, each one pass that counts violations; nothing is raised until asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed prefixes of feature columns; ctx and time are derived.
SENSORS = ("acc", "ppg", "hr", "ecg", "eda", "emg", "resp", "temp", "steps", "ctx", "time")
REQUIRED = ("dataset", "client_id", "y", "feature_start", "feature_end", "label_start", "label_end", "declared_lookahead_s")


def sensor_columns(df: DataFrame, sensors: tuple[str, ...] = SENSORS) -> list[str]:
    return sorted(c for c in df.columns if c.split("_")[0] in sensors)


def violations(df: DataFrame, most_lookahead_s: float, features: list[str]) -> DataFrame:
    """One row per rule with the number of rows (or keys) that break it; missing columns are a ValueError."""
    if gone := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {gone}")
    if not features:
        raise ValueError("no sensor column")
    inf = F.lit(float("inf"))
    look, c = F.col("declared_lookahead_s"), F.col
    bad = lambda x: F.coalesce(x, F.lit(True))  # noqa: E731  a null breaks the rule
    rules = {
        "null_client": c("client_id").isNull(),
        "label_not_binary": bad(~c("y").isin(0, 1)),
        "feature_interval": bad(c("feature_start") >= c("feature_end")),
        "label_interval": bad(c("label_start") >= c("label_end")),
        "lookahead_invalid": bad(F.isnan(look) | (look < 0) | (look == inf)),
        "lookahead_over_bound": bad(look > most_lookahead_s + 1e-8),
        "overshoot_undeclared": bad(c("feature_end") - c("label_end") > look + 1e-8),
        "infinite_feature": F.greatest(*[F.coalesce(F.abs(c(f).cast("double")) == inf, F.lit(False)).cast("int") for f in features], F.lit(0)) == 1,
    }
    rows = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(x).alias(k) for k, x in rules.items()])
    repeated = df.groupBy("client_id", "label_start").count().agg(F.count_if(F.col("count") > 1).alias("repeated_epoch"))
    mixed = df.groupBy("client_id").agg(F.countDistinct("dataset").alias("k")).agg(F.count_if(F.col("k") > 1).alias("client_in_datasets"))
    wide = rows.withColumn("empty", F.when(F.col("__n") == 0, 1).otherwise(0).cast("long")).drop("__n").crossJoin(repeated).crossJoin(mixed)  # one row each
    return wide.unpivot([], wide.columns, "rule", "violations")


def check(df: DataFrame, most_lookahead_s: float, features: list[str] | None = None) -> DataFrame:
    """The frame in its order by dataset, client and label start, or a ValueError that names the broken rules."""
    features = features or sensor_columns(df)
    broken = {r["rule"]: r["violations"] for r in violations(df, most_lookahead_s, features).filter("violations > 0").collect()}
    if broken:
        raise ValueError(f"invalid frame: {broken}")
    return df.orderBy("dataset", "client_id", "label_start")


def role_leakage(roles: DataFrame) -> DataFrame:
    """held, problem, detail: clients in several roles of a split, and roles that a split lacks. No row: disjoint roles."""
    several = roles.groupBy("held", "client_id").agg(F.countDistinct("role").alias("n")).filter("n > 1").select("held", F.lit("client_in_roles").alias("problem"), F.col("client_id").alias("detail"))
    want = F.explode(F.array(*[F.lit(r) for r in ("fit", "val", "cal", "test")]))
    lacking = roles.select("held").distinct().select("held", want.alias("role")).join(roles.select("held", "role").distinct(), ["held", "role"], "left_anti")
    return several.unionByName(lacking.select("held", F.lit("empty_role").alias("problem"), F.col("role").alias("detail")))


def frame_hash(df: DataFrame) -> DataFrame:
    """rows and an order-insensitive hash of the frame."""
    return df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash"))
