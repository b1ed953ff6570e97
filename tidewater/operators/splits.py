"""Leave-one-participant-out splits in four disjoint roles, ordered by named hashes instead of random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import named_hash


def loso_roles(clients: DataFrame, seed: int = 0, val_subjects: int = 3, folds: int | None = None) -> DataFrame:
    """clients (dataset, client_id) as dataset, held, client_id, role for each held-out client.

    Of the others, in hash order, min(val_subjects, max(1, (rest - 3) // 2)) are val, as many cal, and the rest fit.
    Datasets of fewer than five clients give no split. With folds, so many clients of each dataset are held out.
    """
    c = clients.select("dataset", "client_id").distinct().withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("dataset"))).filter("__n >= 5")
    picked = F.row_number().over(Window.partitionBy("dataset").orderBy(named_hash("fold", seed, F.col("client_id"))))
    held = c.withColumn("__k", picked).filter(F.lit(True) if folds is None else F.col("__k") <= folds).select("dataset", F.col("client_id").alias("held"), "__n")
    pairs = held.join(c.select("dataset", "client_id"), "dataset")
    rank = F.row_number().over(Window.partitionBy("dataset", "held").orderBy(F.col("client_id") == F.col("held"), named_hash("split", seed, F.col("held"), F.col("client_id"))))
    nv = F.least(F.lit(val_subjects), F.greatest(F.lit(1), F.floor((F.col("__n") - 1 - 3) / 2)))
    role = F.when(F.col("client_id") == F.col("held"), "test").when(F.col("__r") <= nv, "val").when(F.col("__r") <= 2 * nv, "cal").otherwise("fit")
    return pairs.withColumn("__r", rank).select("dataset", "held", "client_id", role.alias("role"))


def role_rows(df: DataFrame, roles: DataFrame, held: str, role: str) -> DataFrame:
    """The rows of the clients that have the role when held is held out."""
    return df.join(roles.filter((F.col("held") == held) & (F.col("role") == role)).select("dataset", "client_id"), ["dataset", "client_id"], "left_semi")


def shard_jobs(jobs: DataFrame, order: list[str], k: int, n: int) -> DataFrame:
    """Each n-th job from the k-th on, in the given order; a table of jobs is small (splits times seeds)."""
    return jobs.withColumn("__i", F.row_number().over(Window.orderBy(*order)) - 1).filter(F.pmod("__i", F.lit(n)) == k).drop("__i")


def seeded_jobs(roles: DataFrame, seeds: list[int]) -> DataFrame:
    return roles.select("dataset", "held").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def merge_shards(shards: list[DataFrame], expected: int, keys: list[str]) -> DataFrame:
    """The union of all shards; a ValueError for an incomplete set or a job that two shards hold."""
    if len(shards) != expected:
        raise ValueError(f"{len(shards)} of {expected} shards")
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    if again := out.groupBy(*keys).count().filter("count > 1").take(1):
        raise ValueError(f"job in two shards: {again[0].asDict()}")
    return out
