"""Binary metrics by group: confusion counts, tie-aware AUROC and average precision, calibration errors, threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip

GRID = [0.02 + 0.005 * i for i in range(193)]


def _ratio(a, b):
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def _f1(hit, wrong):
    return F.coalesce(_ratio(2 * hit, 2 * hit + wrong), F.lit(0.0))


def confusion(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts, rates, F1, Brier, log loss and kappa of y and p by keys. p is clipped to [1e-7, 1 - 1e-7]."""
    rows = df.withColumn("p", clip(F.col("p"), 1e-7, 1 - 1e-7)).withColumn("__hat", (F.col("p") >= threshold).cast("int"))
    is_ = lambda y, h: F.count_if((F.col("y") == y) & (F.col("__hat") == h))
    agg = rows.groupBy(*keys).agg(
        is_(0, 0).alias("tn"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(1, 1).alias("tp"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        F.avg(-F.when(F.col("y") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))).alias("nll"),
    )
    c = F.col
    n = c("tn") + c("fp") + c("fn") + c("tp")
    agree = (c("tp") + c("tn")) / n
    chance = ((c("tp") + c("fp")) * (c("tp") + c("fn")) + (c("tn") + c("fn")) * (c("tn") + c("fp"))) / (n * n)
    both = ((c("tp") + c("fn")) > 0) & ((c("tn") + c("fp")) > 0)
    out = agg.withColumns({"n": n, "n_class1": c("tp") + c("fn"), "prevalence": (c("tp") + c("fn")) / n, "degenerate": ~both, "f1_class1": _f1(c("tp"), c("fp") + c("fn")), "f1_class0": _f1(c("tn"), c("fp") + c("fn"))})
    out = out.withColumns({"sensitivity": _ratio(c("tp"), c("tp") + c("fn")), "specificity": _ratio(c("tn"), c("tn") + c("fp")), "accuracy": agree, "macro_f1": (c("f1_class0") + c("f1_class1")) / 2, "kappa": F.when(both, _ratio(agree - chance, 1 - chance))})
    return out.withColumn("balanced_acc", (c("sensitivity") + c("specificity")) / 2)


def auroc_ap(df: DataFrame, keys: list[str]) -> DataFrame:
    """auroc (average ranks of ties) and the step-wise average precision of both classes, by keys; null for one class.

    Scores are first counted by distinct value, so ties and large groups cost one row per value in the windows.
    """
    counts = df.groupBy(*keys, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    by = Window.partitionBy(*keys)
    down = by.orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = by.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    rows = counts.withColumns({"__tp": F.sum("pos").over(down), "__fp": F.sum("neg").over(down), "__fn": F.sum("pos").over(up), "__tn": F.sum("neg").over(up)})
    return rows.groupBy(*keys).agg(
        _ratio(F.sum(c("pos") * (c("__tn") - c("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auroc"),
        _ratio(F.sum(c("pos") * c("__tp") / (c("__tp") + c("__fp"))), F.when(F.sum("neg") > 0, F.sum("pos"))).alias("ap_class1"),
        _ratio(F.sum(c("neg") * c("__tn") / (c("__tn") + c("__fn"))), F.when(F.sum("pos") > 0, F.sum("neg"))).alias("ap_class0"),
    )


def minority(df: DataFrame, keys: list[str], minority_class: int) -> DataFrame:
    """Average precision of the minority class and its lift over the class's share."""
    base = df.groupBy(*keys).agg(F.avg((F.col("y") == minority_class).cast("double")).alias("__share"))
    ap = F.col(f"ap_class{minority_class}")
    return auroc_ap(df, keys).join(base, keys).select(*keys, ap.alias("minority_ap"), _ratio(ap, F.col("__share")).alias("minority_ap_lift"))


def calibration_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """probability_ece and confidence_ece over ten bins; confidence counts a row as correct at the threshold 0.5."""
    p = clip(F.col("p"), 1e-7, 1 - 1e-7)
    conf = F.greatest(p, 1 - p)
    right = (F.col("y") == (p >= 0.5).cast("int")).cast("double")
    kinds = F.array(F.struct(F.lit("probability").alias("kind"), p.alias("x"), F.col("y").cast("double").alias("hit")), F.struct(F.lit("confidence").alias("kind"), conf.alias("x"), right.alias("hit")))
    binned = df.select(*keys, F.explode(kinds).alias("__k")).select(*keys, "__k.*").withColumn("__bin", F.least(F.floor(F.col("x") * 10), F.lit(9)))
    gaps = binned.groupBy(*keys, "kind", "__bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("x") - F.avg("hit")).alias("gap"))
    return gaps.groupBy(*keys).agg(*[_ratio(F.sum(F.when(F.col("kind") == k, F.col("n") * F.col("gap"))), F.sum(F.when(F.col("kind") == k, F.col("n")))).alias(f"{k}_ece") for k in ("probability", "confidence")])


def participant_score(df: DataFrame, client: str, threshold: float = 0.5, metric: str = "macro_f1") -> DataFrame:
    """The mean over clients of a metric of each; clients for which it is null do not count."""
    return confusion(df, [client], threshold).agg(F.avg(metric).alias(metric), F.count(metric).alias("clients"))


def threshold_scan(df: DataFrame, client: str, keys: list[str] | None = None, grid: list[float] | None = None) -> DataFrame:
    """Mean macro F1 over clients at each threshold of the grid, for each of keys: one pass.

    A row falls into the bin of the highest threshold it reaches; running sums over a client's bins give its confusion
    counts at all thresholds, so rows are never multiplied by the grid.
    """
    keys, grid = keys or [], grid or GRID
    steps = F.array(*[F.lit(float(t)) for t in grid])
    reached = F.size(F.filter(steps, lambda t: F.col("p") >= t))
    binned = df.groupBy(*keys, client, reached.alias("__b")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    arrays = binned.groupBy(*keys, client).agg(F.map_from_entries(F.collect_list(F.struct("__b", F.struct("pos", "neg")))).alias("__m"), F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    each = arrays.select(*keys, client, "__pos", "__neg", "__m", F.posexplode(steps).alias("i", "threshold"))
    above = lambda part: F.aggregate(F.map_entries("__m"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] > F.col("i"), e["value"][part]).otherwise(0))
    tp, fp = above("pos"), above("neg")
    counted = each.select(*keys, client, "threshold", tp.alias("tp"), fp.alias("fp"), (F.col("__pos") - tp).alias("fn"), (F.col("__neg") - fp).alias("tn"))
    score = (_f1(F.col("tp"), F.col("fp") + F.col("fn")) + _f1(F.col("tn"), F.col("fp") + F.col("fn"))) / 2
    return counted.groupBy(*keys, "threshold").agg(F.avg(score).alias("score"))


def best_threshold(scan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The best threshold of a scan; scores that differ by less than 1e-12 tie, and the one closest to 0.5 wins."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.round("score", 12).desc(), F.abs(F.col("threshold") - 0.5), "threshold")
    return scan.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def summary(per_run: DataFrame, metrics: list[str], least: int = 6, reps: int = 200) -> DataFrame:
    """dataset, metric and its distribution over participants, after the mean over each one's seeds."""
    each = per_run.groupBy("dataset", "client_id").agg(*[F.avg(m).alias(m) for m in metrics], F.countDistinct("seed").alias("__seeds"))
    long = each.unpivot(["dataset", "client_id", "__seeds"], metrics, "metric", "x")
    out = long.groupBy("dataset", "metric").agg(
        F.countDistinct("client_id").alias("n_subjects"), F.count("x").alias("n_valid_subjects"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.percentile("x", F.lit(0.5)).alias("median"), F.percentile("x", F.lit(0.1)).alias("p10"), F.min("x").alias("minimum"), F.max("x").alias("maximum"), F.min("__seeds").alias("n_seeds_min"),
    )
    from .stats import bootstrap_mean

    ci = bootstrap_mean(long, ["dataset", "metric"], "client_id", "x", reps, 0, least).select("dataset", "metric", "ci_low", "ci_high")
    return out.join(ci, ["dataset", "metric"], "left").withColumn("ci_reportable", F.col("ci_low").isNotNull())
