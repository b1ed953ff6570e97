"""Linear fingerprints of client updates: count sketches, audits, robust screening, aggregation, attack simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import named_hash, named_int, norm

EPS32 = 1.1920928955078125e-07


def hash_table(spark: SparkSession, dim: int, buckets: int, seed: int) -> DataFrame:
    """coord, bucket, sign: a fresh table for each seed (one per round)."""
    coord = spark.range(dim).select(F.col("id").cast("int").alias("coord"))
    sign = F.when(named_int(2, "sign", seed, F.col("coord")) == 0, 1.0).otherwise(-1.0)
    return coord.select("coord", named_int(buckets, "bucket", seed, F.col("coord")).cast("int").alias("bucket"), sign.alias("sign"))


def sketch(updates: DataFrame, table: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, bucket, s: signed sums of each update's coordinates."""
    long = updates.select(*keys, F.posexplode(vector).alias("coord", "x"))
    return long.join(F.broadcast(table), "coord").groupBy(*keys, "bucket").agg(F.sum(F.col("sign") * F.col("x").cast("double")).alias("s"))


def operator_norm(table: DataFrame) -> DataFrame:
    """opnorm: the root of the largest bucket load."""
    return table.groupBy("bucket").count().agg(F.sqrt(F.max("count")).alias("opnorm"))


def audit(computed: DataFrame, declared: DataFrame, table: DataFrame, keys: list[str], buckets: int, clip_norm: float, slack: float = 8.0) -> DataFrame:
    """keys, residual, size, tolerance and reason: inconsistent_sketch, else oversized_sketch, else null."""
    both = computed.withColumnRenamed("s", "__a").join(declared.withColumnRenamed("s", "__b"), [*keys, "bucket"], "full")
    a, b = F.coalesce("__a", F.lit(0.0)), F.coalesce("__b", F.lit(0.0))
    sums = both.groupBy(*keys).agg(F.sqrt(F.sum((a - b) * (a - b))).alias("residual"), F.sqrt(F.sum(b * b)).alias("size"))
    out = sums.crossJoin(F.broadcast(operator_norm(table)))  # one row
    tol = F.greatest(F.lit(slack * EPS32 * clip_norm * float(np.sqrt(buckets))) * F.col("opnorm"), F.lit(1e-9))
    why = F.when(F.col("residual") > tol, "inconsistent_sketch").when(F.col("size") > F.col("opnorm") * clip_norm * 1.001, "oversized_sketch")
    return out.withColumns({"tolerance": tol, "reason": why}).drop("opnorm")


def null_vectors(table: DataFrame, seed: int) -> DataFrame:
    """coord, v: a unit vector that the sketch maps to zero, from hashed noise less its bucket's signed mean."""
    noise = named_int(2000001, "noise", seed, F.col("coord")) / 1e6 - 1
    by = Window.partitionBy("bucket")
    free = table.withColumn("__z", noise).withColumn("__z", F.col("__z") - F.col("sign") * F.sum(F.col("sign") * F.col("__z")).over(by) / F.count(F.lit(1)).over(by))
    size = free.agg(F.sqrt(F.sum(F.col("__z") * F.col("__z"))).alias("__n"))  # one row
    return free.crossJoin(F.broadcast(size)).select("coord", (F.col("__z") / F.greatest("__n", F.lit(1e-300))).alias("v"))


def geometric_median(points: np.ndarray, weights: np.ndarray, iterations: int = 60, tol: float = 1e-7) -> tuple[np.ndarray, bool, int]:
    """Weiszfeld steps from the weighted mean; distances are floored at 1e-12. Returns centre, convergence and steps."""
    centre = weights @ points / weights.sum()
    for step in range(1, iterations + 1):
        pull = weights / np.maximum(np.linalg.norm(points - centre, axis=1), 1e-12)
        moved = pull @ points / pull.sum()
        if np.linalg.norm(moved - centre) < tol:
            return moved, True, step
        centre = moved
    return centre, False, iterations


def group_medians(df: DataFrame, group: str, vector: str, iterations: int = 60, tol: float = 1e-7) -> DataFrame:
    """group, coord, centre, converged: the geometric median of each group's vectors (a group is a round's clients)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part[vector].tolist(), dtype=float)
        c, ok, _ = geometric_median(x, np.ones(len(x)), iterations, tol)
        return pd.DataFrame({group: part[group].iloc[0], "coord": np.arange(len(c), dtype=np.int32), "centre": c, "converged": ok})

    kind = dict(df.dtypes)[group]
    return df.groupBy(group).applyInPandas(run, f"{group} {kind}, coord int, centre double, converged boolean")


# Fixed bounds of the screen: least norm of a consensus, most opposed cosine, spreads from the median that count and the
# gaps they must come with, a spread of a normal sample in units of MAD and its floors, weight of a flagged client.
MIN_CONSENSUS, MAX_OPPOSED, MAX_Z, MIN_COS_GAP, MIN_NORM_GAP, MAD, COS_FLOOR, NORM_FLOOR, LOW_TRUST = 0.1, -0.25, 4.5, 0.55, 1.25, 1.4826, 0.1, 0.25, 0.1


def left_out_medians(points: np.ndarray, iterations: int = 60, tol: float = 1e-7, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each point the geometric median of all others, as geometric_median steps to it, and whether it got there; a
    block of points at a time."""
    n, out, there = len(points), np.zeros(points.shape, dtype=float), np.zeros(len(points), dtype=bool)
    if n < 2:
        return out, there
    squares, total = (points * points).sum(1), points.sum(0)
    for start in range(0, n, block):
        rows = np.arange(start, min(start + block, n))
        centre = (total - points[rows]) / (n - 1)
        going = np.arange(len(rows))
        for _ in range(iterations):
            now = centre[going]
            pull = 1 / np.maximum(np.sqrt(np.maximum(squares - 2 * now @ points.T + (now * now).sum(1)[:, None], 0.0)), 1e-12)
            pull[np.arange(len(going)), rows[going]] = 0.0
            moved = pull @ points / pull.sum(1)[:, None]
            centre[going] = moved
            still = np.linalg.norm(moved - now, axis=1) >= tol
            there[rows[going[~still]]] = True
            going = going[still]
            if not len(going):
                break
        out[rows] = centre
    return out, there | (tol < 0)  # without a tolerance the steps are all that is asked for


def _against_others(seen: np.ndarray, own: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The median of each column without its own entry (marked NaN in seen), and own's distance below it in spreads."""
    middle = np.nanmedian(seen, axis=0)
    spread = np.maximum(MAD * np.nanmedian(np.abs(seen - middle), axis=0), floor)
    return middle, (middle - own) / spread


def screened(vectors: np.ndarray, iterations: int = 60, tol: float = 1e-7, block: int = 256) -> dict[str, np.ndarray]:
    """The screen of one group of clients, each against the consensus of the others: their left-out geometric median.

    A client's cosine to it is compared with the others' cosines to the same consensus, its log norm with the others'. Only
    what is too large is flagged for its size. Clients whose others have no consensus pass unscreened.
    """
    size = np.linalg.norm(vectors, axis=1)
    unit, logs = vectors / np.maximum(size, 1e-12)[:, None], np.log(np.maximum(size, 1e-12))
    centres, there = left_out_medians(unit, iterations, tol, block)
    length = np.linalg.norm(centres, axis=1)
    out = {k: np.full(len(unit), np.nan) for k in ("cosine", "z_cosine", "z_norm", "gap_cosine", "gap_norm")}
    for start in range(0, len(unit), block):
        mine = np.arange(start, min(start + block, len(unit)))
        places = (mine, np.arange(len(mine)))
        seen = unit @ (centres[mine] / np.maximum(length[mine], 1e-12)[:, None]).T
        own = seen[places].copy()
        sizes = np.repeat(logs[:, None], len(mine), axis=1)
        seen[places] = sizes[places] = np.nan
        if len(unit) > 1:
            middle, z = _against_others(seen, own, COS_FLOOR)
            usual, far = _against_others(sizes, logs[mine], NORM_FLOOR)
            for name, values in (("cosine", own), ("z_cosine", z), ("gap_cosine", middle - own), ("z_norm", -far), ("gap_norm", logs[mine] - usual)):
                out[name][mine] = values
    weak = length < MIN_CONSENSUS
    direction = (out["cosine"] < MAX_OPPOSED) | ((out["z_cosine"] > MAX_Z) & (out["gap_cosine"] > MIN_COS_GAP))
    flagged = (direction | ((out["z_norm"] > MAX_Z) & (out["gap_norm"] > MIN_NORM_GAP))) & ~weak & there
    reason = np.where(weak, "no_consensus", np.where(~there, "median_not_converged", np.where(flagged, "flagged", "clean")))
    for name in ("cosine", "z_cosine", "z_norm"):
        out[name] = np.where(weak | ~there, np.nan, out[name])
    return {k: out[k] for k in ("cosine", "z_cosine", "z_norm")} | {"consensus": length, "screened": ~weak & there, "flagged": flagged, "reason": reason, "weight": np.where(flagged, LOW_TRUST, 1.0)}


def robust_screen(updates: DataFrame, group: str, client: str, vector: str, least: int = 5, steps: int | None = None) -> DataFrame:
    """group, client, cosine, z_cosine, z_norm, consensus, screened, flagged, reason, weight: screened() of each group.

    A group is a round's clients and meets in one task. Groups of fewer than least pass unscreened (warmup). With steps the
    medians are taken after just so many, as a table in SQL would be; else they must converge.
    """
    names = ["cosine", "z_cosine", "z_norm", "consensus", "screened", "flagged", "reason", "weight"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part[vector].tolist(), dtype=float)
        if len(x) < least:
            got = dict.fromkeys(names[:4], np.full(len(x), np.nan)) | {"screened": False, "flagged": False, "reason": "warmup", "weight": 1.0}
        else:
            got = screened(x, steps or 60, 1e-7 if steps is None else -1.0)
        return pd.DataFrame({group: part[group].to_numpy(), client: part[client].to_numpy(), **{n: got[n] for n in names}})

    kinds = dict(updates.dtypes)
    out = updates.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {client} {kinds[client]}, cosine double, z_cosine double, z_norm double, consensus double, screened boolean, flagged boolean, reason string, weight double")
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names[:4]})


def aggregate_updates(long: DataFrame, group: str) -> DataFrame:
    """long (group, coord, x, weight, support): the weighted sum over the weight of supporting clients; 0 without any."""
    sums = long.groupBy(group, "coord").agg(F.sum(F.col("weight") * F.col("x")).alias("__a"), F.sum(F.col("weight") * F.col("support").cast("double")).alias("__b"))
    return sums.select(group, "coord", F.when(F.col("__b") > 1e-12, F.col("__a") / F.col("__b")).otherwise(0.0).alias("update"))


ATTACKS = ("clean", "sign_flip", "scaled", "gaussian", "sketch_forgery", "nullspace", "free_rider", "label_flip")


def attacked(vector, kind, noise=None, null=None, size=None):
    """The payload an attacker of a kind sends instead of vector; gaussian and nullspace need arrays of noise.

    The clean and label_flip kinds send the vector (a flipped label acts in training).
    """
    times = lambda k: F.transform(vector, lambda x: x.cast("double") * F.lit(k))
    out = F.when(kind == "sign_flip", times(-5.0)).when(kind == "scaled", times(5.0)).when(kind == "sketch_forgery", times(-2.5)).when(kind == "free_rider", times(0.0))
    if noise is not None:
        out = out.when(kind == "gaussian", F.transform(noise, lambda x: x * (size if size is not None else norm(vector))))
    if null is not None:
        out = out.when(kind == "nullspace", F.zip_with(vector, null, lambda x, z: x.cast("double") + 5.0 * norm(vector) * z))
    return out.otherwise(times(1.0))


def malicious(clients: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """clients with malicious: the first max(1, fraction * n) in hash order, none for a fraction of 0."""
    all_ = Window.partitionBy(F.lit(0))  # one row per client of a federation
    rank = F.row_number().over(all_.orderBy(named_hash("malicious", seed, F.col(key))))
    most = F.when(F.lit(fraction) > 0, F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.count(F.lit(1)).over(all_)))).otherwise(0)
    return clients.withColumn("malicious", rank <= most)


def participants(clients: DataFrame, key: str, per_round: int, rounds: int, seed: int) -> DataFrame:
    """round, client: the first per_round clients of each round's hash order."""
    pairs = clients.select(key).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    rank = F.row_number().over(Window.partitionBy("round").orderBy(named_hash("participation", seed, F.col("round"), F.col(key))))
    return pairs.withColumn("__r", rank).filter(F.col("__r") <= per_round).drop("__r")


def device_caps(clients: DataFrame, key: str, tiers: list[int], seed: int) -> DataFrame:
    """clients with cap: tiers dealt round-robin over a hash order."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(named_hash("tier", seed, F.col(key)))) - 1
    return clients.withColumn("cap", F.element_at(F.array(*[F.lit(t) for t in tiers]), (F.pmod(rank, F.lit(len(tiers))) + 1).cast("int")))
