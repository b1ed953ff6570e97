"""Raw recordings to a validated frame: extraction, context of each epoch, provenance, and a cache by content."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate, windows
from ..sources import nested_signals, store, synthetic, text_series
from . import extract

# Subjects of the stress recordings, and the features that context is computed of, by dataset.
SUBJECTS = ("S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "S10", "S11", "S13", "S14", "S15", "S16", "S17")
BASE = {
    "SLEEP": ("acc_watch_mag_mean", "acc_watch_mag_std", "acc_watch_activity", "acc_watch_a0_std", "hr_epoch_mean", "hr_epoch_std", "hr_epoch_dmean", "hr_context_mean", "steps_complete_mean"),
    "WESAD": ("acc_wrist_mag_mean", "acc_wrist_activity", "eda_wrist_mean", "eda_wrist_slope", "temp_wrist_mean", "ppg_wrist_pulse_rate_median", "ecg_chest_pulse_rate_median", "resp_chest_mean"),
}


@dataclass(frozen=True)
class DataConfig:
    """Where recordings are and how frames are made of them. sleep_dir holds labels, motion, heart_rate and steps."""

    wesad_dir: str | None = None
    sleep_dir: str | None = None
    wesad_subjects: tuple[str, ...] = SUBJECTS
    window_s: float = 60.0
    stride_s: float = 30.0
    sleep_label_position: str = "start"
    amusement: bool = True
    sensor_profile: str = "all"
    cache_dir: str = "tidewater_cache"
    strict_subjects: bool = True
    context_enabled: bool = True
    context_scales: dict[str, tuple[int, ...]] = field(default_factory=lambda: {"SLEEP": (4, 12, 40), "WESAD": (2, 6)})
    context_forward: dict[str, bool] = field(default_factory=lambda: {"SLEEP": True, "WESAD": False})
    context_base: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(BASE))
    context_centered: bool = True
    context_subject_relative: bool = True
    context_time_features: bool = True
    context_time_mode: str = "causal"
    context_max_lookahead_s: float = 600.0


def data_config(wesad_dir: str | None = None, sleep_dir: str | None = None, **changes) -> DataConfig:
    return replace(DataConfig(wesad_dir, sleep_dir), **changes)


def code_fingerprint() -> str:
    """A hash of the package's sources, by which caches of older code are not found."""
    h = hashlib.sha256()
    root = Path(__file__).resolve().parents[1]
    for path in sorted(root.rglob("*.py")):
        if "llm" not in path.relative_to(root).parts:
            h.update(str(path.relative_to(root)).encode() + b"\0" + path.read_bytes())
    return h.hexdigest()


def _usable(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Of the names those that are columns with a value."""
    there = [n for n in names if n in df.columns]
    counts = df.agg(*[F.count(n).alias(n) for n in there]).first() if there else {}
    return [n for n in there if counts[n]]


def dataset_context(df: DataFrame, c: DataConfig, dataset: str, base: list[str]) -> DataFrame:
    """The frame of one dataset with ctx_ and time_ columns, a wider span and the look-ahead that it declares.

    All windows are of one recording, ordered by label_start: one shuffle. The look-ahead is declared as half of the
    longest scale, for centred as for forward windows.
    """
    key, at, tie = "client_id", "label_start", "label_end"
    order, scales, forward = [at, tie], list(c.context_scales.get(dataset, (4, 12, 40))), c.context_forward.get(dataset, c.context_centered)
    own = df.columns
    rows = windows.contiguous_runs(df, key, at, tie)
    named: dict[str, Column] = {}
    kinds = ("cm", "cs", "dev", "bm", "fm", "asym") if forward else ("cm", "cs", "dev", "bm")
    for x in base:
        filled = f"{x}_filled"
        rows = windows.context_features(windows.interpolate(rows, key, order, x), key, order, filled, scales, c.context_centered, forward)
        named |= {f"ctx_{x}_{k}{w}": F.col(f"{filled}_{k}_{w}") for w in scales for k in kinds}
        if c.context_subject_relative:
            rows = windows.subject_ranks(rows, key, filled)
            named |= {f"ctx_{x}_{k}": F.col(f"{filled}_{k}") for k in ("z", "pct")}
    if c.context_time_features:
        retro = c.context_time_mode == "retrospective"
        moving = next((x for x in base if "activity" in x or "mag_mean" in x), None)
        rows = windows.elapsed(rows, key, at)
        named |= {"time_elapsed_min": F.col("elapsed_min"), "time_log_elapsed": F.col("elapsed_log")}
        rows = windows.activity(rows.withColumn("__move", F.coalesce(f"{moving}_filled", F.lit(0.0)) if moving else F.lit(0.0)), key, "__move")
        if moving:
            rows = windows.since_movement(rows, key, at, tie)
            named |= {"time_mean_activity_so_far": F.col("activity_so_far"), "time_since_move_min": F.col("minutes_still")}
        if retro:
            rows = windows.retrospective(rows, key, at, tie)
            names = {"frac": "elapsed_frac", "remaining_min": "remaining_min", "frac_cos": "progress_cos", "frac_sin": "progress_sin"} | ({"activity_passed": "cum_activity_frac"} if moving else {})
            named |= {f"time_r_{new}": F.col(old) for old, new in names.items()}
    reach = F.col("step") * max(scales)
    ahead = reach / 2 if c.context_centered or forward else F.lit(0.0)
    span = {"feature_start": F.least("feature_start", F.col(at) - reach), "feature_end": F.greatest("feature_end", F.col("label_end") + ahead), "declared_lookahead_s": ahead}
    return rows.select(*[span[n].alias(n) if n in span else F.col(n) for n in own], *[v.alias(n) for n, v in named.items()])


def context_frame(df: DataFrame, c: DataConfig) -> tuple[DataFrame, dict]:
    """df with the context of its datasets (a few, one after the other), and a report of what was computed."""
    report: dict = {"enabled": c.context_enabled, "centered": c.context_centered, "time_mode": c.context_time_mode, "per_dataset": {}}
    if not c.context_enabled:
        return df, report
    parts = []
    for dataset in sorted(r["dataset"] for r in df.select("dataset").distinct().collect()):  # a few datasets
        part = df.filter(F.col("dataset") == dataset)
        base = _usable(part, tuple(c.context_base.get(dataset, ())))
        report["per_dataset"][dataset] = {"base_columns": base, "scales": list(c.context_scales.get(dataset, (4, 12, 40))), "forward": c.context_forward.get(dataset, c.context_centered)}
        parts.append(dataset_context(part, c, dataset, base) if base else part)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    report["n_context_features"] = sum(x.startswith(("ctx_", "time_")) for x in out.columns)
    return out, report


def _sources(spark: SparkSession, c: DataConfig) -> DataFrame:
    """path, size and time of all recordings; missing mandatory ones are an error."""
    files = []
    if c.wesad_dir:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pkl").load(c.wesad_dir)
        files.append(found.filter(F.regexp_extract("path", r"([^/]+)\.pkl$", 1).isin(*c.wesad_subjects)))
    if c.sleep_dir:
        gone = text_series.subjects(spark, c.sleep_dir).filter(F.size("missing") > 0).first()
        if gone:
            raise FileNotFoundError(f"{gone['client_id']} lacks {gone['missing']}")
        files.append(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(c.sleep_dir))
    if not files:
        raise FileNotFoundError("no recordings named: give wesad_dir or sleep_dir; nothing synthetic takes their place")
    return reduce(DataFrame.unionByName, files).select("path", "length", F.col("modificationTime").cast("string").alias("time"))


def _sleep(spark: SparkSession, c: DataConfig) -> tuple[DataFrame, DataFrame]:
    v = lambda i: F.get("v", F.lit(i))
    kind = {k: text_series.read_kind(spark, c.sleep_dir, k) for k in text_series.KINDS}
    labels = kind["labels"].select("client_id", "t", v(0).alias("stage"))
    motion = kind["motion"].select("client_id", "t", v(0).alias("x"), v(1).alias("y"), v(2).alias("z"))
    frame = extract.sleep_frame(labels, motion, kind["heart_rate"].select("client_id", "t", v(0).alias("hr")), kind["steps"].select("client_id", "t", v(0).alias("n")), c.sleep_label_position)
    return frame, labels.select("client_id").distinct()


def _stress(spark: SparkSession, c: DataConfig) -> tuple[DataFrame, DataFrame]:
    paths = [r["path"] for r in _sources(spark, replace(c, sleep_dir=None)).select("path").collect()]  # a file per subject
    samples, labels = nested_signals.read_nested(spark, paths, c.sensor_profile == "wrist")
    return extract.stress_frame(samples, labels, c.window_s, c.stride_s, c.amusement), labels.select("client_id").distinct()


def load_data(spark: SparkSession, c: DataConfig, make_synthetic: bool = False) -> tuple[DataFrame, dict]:
    """The validated frame of all recordings with its context, and a manifest of where it came from.

    The frame is stored under a digest of settings, sources and code, and read from there the next time. A subject none of
    whose labels gives an epoch is an error where subjects are strict.
    """
    if make_synthetic:
        frame = validate.check(synthetic.fixture(spark), 0.0)
        return frame, {"source": "synthetic", "synthetic": True, **validate.frame_hash(frame).first().asDict()}
    sources = [r.asDict() for r in _sources(spark, c).orderBy("path").collect()]  # a row per file
    if c.wesad_dir and (gone := set(c.wesad_subjects) - {Path(r["path"]).stem for r in sources if r["path"].endswith(".pkl")}):
        raise FileNotFoundError(f"no recordings of {sorted(gone)}")
    key = store.digest({"config": asdict(c), "sources": sources, "code": code_fingerprint()})
    log: dict = {}

    def make() -> DataFrame:
        made = [f(spark, c) for f, there in ((_stress, c.wesad_dir), (_sleep, c.sleep_dir)) if there]
        raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (frame for frame, _ in made))
        raw = store.cached(spark, c.cache_dir, {"raw": key}, lambda: raw)
        kept = {r["client_id"]: r["n"] for r in raw.groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per subject
        log.update({r["client_id"]: kept.get(r["client_id"], 0) for _, who in made for r in who.collect()})
        if c.strict_subjects and (empty := sorted(x for x, n in log.items() if not n)):
            raise ValueError(f"subjects without an epoch: {empty}")
        frame, report = context_frame(validate.check(raw, 0.0), c)
        log["context"] = report
        return frame

    frame = validate.check(store.cached(spark, c.cache_dir, {"frame": key}, make), c.context_max_lookahead_s)
    where = Path(c.cache_dir.removeprefix("file://")) / f"manifest_{key[:20]}.json"
    told = validate.frame_hash(frame).first().asDict()
    if log or not where.exists():
        context = log.pop("context", {})
        store.write_json(where, {"source": "raw", "synthetic": False, "cache_key": key, "config": asdict(c), "sources": sources, "extraction_log": log, "context": context, "n_features": len(validate.sensor_columns(frame)), **told})
    manifest = store.read_json(where)
    if manifest["hash"] != told["hash"]:
        raise ValueError("the cached frame has changed since it was written")
    return frame, manifest
