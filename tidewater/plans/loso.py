"""Leave-one-participant-out evaluation: train, calibrate, smooth, choose a threshold, score, personalise, report."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import sigmoid, softplus
from ..operators import calibrate, decoding, joins, metrics, model, personalize, preprocess, splits, validate, windows
from ..sources import store

ORDER = ["label_start"]
LR_GRID = (0.003, 0.01)


@dataclass
class Artifact:
    """All that scoring needs, as plain numbers (JSON, no pickle)."""

    scaler: preprocess.RobustScaler
    net: model.Net
    theta: list[float]
    calibration: calibrate.Calibration
    chain: decoding.Chain
    strength: float
    threshold: float

    def save(self, path: str | Path) -> None:
        store.write_json(path, {"scaler": asdict(self.scaler), "net": asdict(self.net), "theta": list(self.theta), "calibration": asdict(self.calibration), "chain": asdict(self.chain), "strength": self.strength, "threshold": self.threshold})

    @classmethod
    def load(cls, path: str | Path) -> Artifact:
        x = json.loads(Path(path).read_text())
        chain = decoding.Chain(tuple(x["chain"]["prior"]), tuple(map(tuple, x["chain"]["steps"])))
        return cls(preprocess.RobustScaler(**x["scaler"]), model.Net(**x["net"]), x["theta"], calibrate.Calibration(**x["calibration"]), chain, x["strength"], x["threshold"])


def inputs(df: DataFrame, scaler: preprocess.RobustScaler, keep: list[str], missing: bool = False) -> DataFrame:
    """keep and x, the model's inputs. With missing, what a row lacks is NaN, by which clients know their inputs."""
    z = scaler.transform(df, keep)
    names = [c for c in z.columns if c.startswith(("z_", "missing_")) and c not in keep]
    if not missing:
        return z.select(*keep, F.array(*names).alias("x"))
    gone = df.groupBy("client_id").agg(*[(F.count(c) == 0).alias(f"__g_{c}") for c in scaler.features if c in df.columns])
    return z.join(gone, "client_id").select(*keep, F.array(*[F.when(F.col(f"__g_{c[2:]}"), float("nan")).otherwise(F.col(c)) if c.startswith("z_") and c[2:] in df.columns else F.col(c) for c in names]).alias("x"))


class Predictor:
    """Logits, probabilities (calibrated and smoothed) and decisions for frames of any columns."""

    def __init__(self, artifact: Artifact):
        self.artifact = artifact

    @classmethod
    def load(cls, path: str | Path) -> Predictor:
        return cls(Artifact.load(path))

    def logits(self, df: DataFrame, keep: list[str]) -> DataFrame:
        a = self.artifact
        return inputs(df, a.scaler, keep).withColumn("z", model.logits_column(a.net, np.array(a.theta), F.col("x"))).drop("x")

    def probabilities(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep (with client_id and label_start), z, p_raw, p_calibrated and p."""
        a = self.artifact
        p = self.logits(df, keep).withColumns({"p_raw": sigmoid(F.col("z")), "p_calibrated": a.calibration.probability(F.col("z"))})
        runs = windows.contiguous_runs(p, "client_id", "label_start", "label_start")
        return decoding.smooth(runs, ["client_id", "run"], ORDER, a.chain, a.strength, "p_calibrated").withColumnRenamed("p_smooth", "p").drop("run", "step")

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return self.probabilities(df, keep).withColumn("prediction", (F.col("p") >= self.artifact.threshold).cast("int"))


KEEP = ["dataset", "client_id", "label_start", "label_end", "feature_start", "feature_end", "y"]


def train(df: DataFrame, roles: DataFrame, held: str, s: model.Settings, scenario: model.Scenario) -> tuple[Artifact, model.State]:
    """Fits on the fit clients, calibrates and counts the label chain on cal, tunes smoothing and threshold on val: no row
    of the held client."""
    part = {r: splits.role_rows(df, roles, held, r) for r in ("fit", "val", "cal")}
    scaler = preprocess.RobustScaler().fit(part["fit"], validate.sensor_columns(df))
    clients = inputs(part["fit"], scaler, ["client_id", "y"], missing=True).cache()
    val = inputs(part["val"], scaler, ["client_id", "y"])
    weight = preprocess.subject_weights(val, "client_id")

    def score(net: model.Net, theta: np.ndarray) -> tuple[float, float]:
        """The participants' mean macro-F1 at a threshold of 0.5, and their mean loss."""
        z = weight.withColumn("z", model.logits_column(net, theta, F.col("x"))).withColumn("p", sigmoid(F.col("z")))
        loss = z.agg(F.sum(F.col("weight") * (softplus(F.col("z")) - F.col("y") * F.col("z"))) / F.sum("weight")).first()[0]
        return metrics.confusion(z, ["client_id"], 0.5).agg(F.avg("macro_f1")).first()[0], loss

    try:
        net, state = model.run_rounds(clients, s, scenario, score)
    finally:
        clients.unpersist()
    theta = state.best[1] if state.best else state.theta
    z = model.logits_column(net, theta, F.col("x"))
    cal = calibrate.fit(inputs(part["cal"], scaler, ["client_id", "y"]).withColumn("z", z), "client_id", "z", "y")
    runs = lambda x: windows.contiguous_runs(x, "client_id", "label_start", "label_start")
    chain = decoding.fit_chain(runs(part["cal"]), ["client_id", "run"], ORDER, "y")
    scored = runs(inputs(part["val"], scaler, ["client_id", "label_start", "y"])).withColumn("p", cal.probability(z)).drop("x")
    strength, threshold = decoding.tune(scored, ["client_id", "run"], ORDER, chain, "client_id", (0.0, 0.5, 1.0))
    return Artifact(scaler, net, theta.tolist(), cal, chain, strength, threshold), state


def choose_lr(df: DataFrame, roles: DataFrame, held: str, s: model.Settings, grid=LR_GRID, rounds: int = 2) -> float:
    """The learning rate whose short, dense, clean run validates best; ties go to the one nearest 0.003."""
    from dataclasses import replace

    best = []
    for lr in grid:
        _, state = train(df, roles, held, replace(s, lr=lr, rounds=rounds, codec="dense", upload_cap=1 << 24), model.Scenario())
        best.append((-state.best[0], abs(np.log(lr / 0.003)), lr))
    return min(best)[2]


def run_fold(df: DataFrame, roles: DataFrame, held: str, s: model.Settings, scenario: model.Scenario, seed: int) -> tuple[Artifact, dict[str, DataFrame]]:
    """The artifact, and the fold's tables: predictions, participant_metrics, personalization, rounds, client_events, system_metrics."""
    spark = df.sparkSession
    artifact, state = train(df, roles, held, s, scenario)
    test = splits.role_rows(df, roles, held, "test")
    p = Predictor(artifact).predict(test, KEEP).withColumn("threshold", F.lit(artifact.threshold))
    keys, tag = ["dataset", "client_id"], lambda x: x.withColumn("seed", F.lit(seed))
    scores = metrics.confusion(p, keys, artifact.threshold).join(metrics.auroc_ap(p, keys), keys).join(metrics.calibration_errors(p, keys), keys)
    own = joins.support_query(p, "client_id", ORDER, 20)
    personal = personalize.personal_rows(own.select("client_id", "z", "y", "part"), artifact.threshold)
    dataset = roles.filter(F.col("held") == held).select("dataset").first()["dataset"]
    logs, events = model.logs_frame(spark, state), model.events_frame(spark, state)
    here = lambda x: tag(x).withColumns({"dataset": F.lit(dataset), "held": F.lit(held), "scenario": F.lit(scenario.attack)})
    tables = {"predictions": tag(p), "participant_metrics": tag(scores), "personalization": tag(personal.withColumn("dataset", F.lit(dataset)))}
    return artifact, tables | {"rounds": here(logs), "client_events": here(events), "system_metrics": here(model.run_summary(logs, events))}


def run_loso(spark: SparkSession, df: DataFrame, root: str, s: model.Settings, scenario: model.Scenario = model.Scenario(), seeds: tuple[int, ...] = (0,), folds: int | None = None, shard: tuple[int, int] = (0, 1)) -> list[dict]:
    """All jobs (splits times seeds) of a shard; each writes its tables under root, failures go to the ledger.

    A job whose result is there under the digest of its settings is not run again.
    """
    from dataclasses import replace

    frame = validate.check(df, 600.0)
    roles = splits.loso_roles(frame.select("dataset", "client_id"), s.seed, 2, folds).cache()
    if bad := validate.role_leakage(roles).take(1):
        raise ValueError(f"roles leak: {bad[0].asDict()}")
    jobs = splits.shard_jobs(splits.seeded_jobs(roles, list(seeds)), ["dataset", "held", "seed"], *shard).orderBy("dataset", "held", "seed").collect()
    ledger = []
    for job in jobs:
        name = store.digest({"job": job.asDict(), "settings": asdict(s), "scenario": asdict(scenario)})[:16]
        entry = {"dataset": job["dataset"], "client_id": job["held"], "seed": job["seed"], "scenario": scenario.attack, "run_dir": name, "status": "completed", "error": ""}
        done = Path(root) / "ledger" / f"{name}.json"
        if not done.exists():
            try:
                artifact, tables = run_fold(frame.filter(F.col("dataset") == job["dataset"]), roles.filter(F.col("dataset") == job["dataset"]), job["held"], replace(s, seed=job["seed"]), scenario, job["seed"])
                artifact.save(f"{root}/artifacts/{name}.json")
                for table, rows in tables.items():
                    rows.write.mode("overwrite").parquet(f"{root}/{table}/run_key={name}")
            except Exception as e:  # a failed fold is reported, and the others run
                entry |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
            if entry["status"] == "completed":
                store.write_json(done, entry)
        ledger.append(entry)
    k, n = shard
    store.write_json(f"{root}/completion_ledger_{k}of{n}.json", ledger)
    return ledger


def md_table(rows: list[dict], columns: list[str], places: int = 3) -> str:
    """A pipe table; what is missing or not finite is n/a."""

    def cell(v) -> str:
        if v is None or isinstance(v, float) and not np.isfinite(v):
            return "n/a"
        return f"{v:.{places}f}" if isinstance(v, float) else str(v)

    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]])


METRICS = ["macro_f1", "accuracy", "balanced_acc", "auroc", "brier", "nll", "probability_ece", "kappa"]


def summarize(spark: SparkSession, root: str) -> str:
    """Writes the summary tables and RESULTS.md of all finished jobs under root; returns the text."""
    ledger = [x for p in sorted(Path(root).glob("completion_ledger_*.json")) for x in json.loads(p.read_text())]
    failed = sum(x["status"] != "completed" for x in ledger)
    per = spark.read.parquet(f"{root}/participant_metrics")
    table = metrics.summary(per, METRICS).orderBy("dataset", "metric")
    store.save_table(table, f"{root}/summary_by_dataset")
    system = spark.read.parquet(f"{root}/system_metrics")
    counted = ["uplink_bytes", "sketch_bytes", "downlink_to_kept", "relative_distortion", "audit_excluded", "infeasible", "screen_tpr", "screen_fpr", "screen_coverage"]
    traffic = system.groupBy("dataset", "scenario").agg(F.count(F.lit(1)).alias("runs"), *[F.avg(c).alias(c) for c in counted])
    store.save_table(traffic, f"{root}/communication")
    # participants count alike, however many seeds they have
    each = spark.read.parquet(f"{root}/personalization").groupBy("dataset", "arm", "client_id").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in ("macro_f1", "nll", "adaptation_eligible", "adaptation_gate_passed")])
    personal = each.groupBy("dataset", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("macro_f1").alias("macro_f1"), F.avg("nll").alias("nll"), F.avg("adaptation_eligible").alias("eligible_share"), F.avg("adaptation_gate_passed").alias("adapted_share"))
    store.save_table(personal, f"{root}/personalization_summary")
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  summaries of a few rows
    text = "\n\n".join([
        "# Results", f"{len(ledger) - failed} of {len(ledger)} jobs completed.", "## Participants",
        md_table(rows(table), ["dataset", "metric", "n_subjects", "mean", "sd", "median", "p10", "minimum", "maximum", "ci_low", "ci_high"]),
        "## Traffic", md_table(rows(traffic.orderBy("dataset", "scenario")), ["dataset", "scenario", "runs", *counted]),
        "## Personalisation", md_table(rows(personal.orderBy("dataset", "arm")), ["dataset", "arm", "n", "macro_f1", "nll", "eligible_share", "adapted_share"]),
    ])
    Path(root, "RESULTS.md").write_text(text + "\n")
    return text
