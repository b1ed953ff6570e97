"""Command line: run folds, merge shards, summarise."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import model
from .plans import data, loso
from .sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewater")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="train and score the folds of a frame")
    run.add_argument("--frame", help="Parquet of epochs; left out: the synthetic fixture")
    run.add_argument("--wesad-dir", help="folder of S2/S2.pkl and so on")
    run.add_argument("--wesad-subjects", nargs="+")
    run.add_argument("--sleep-dir", help="folder of labels, motion, heart_rate and steps")
    run.add_argument("--cache-dir")
    run.add_argument("--datasets", nargs="+", choices=["SLEEP", "WESAD"])
    run.add_argument("--context-time-mode", choices=["causal", "retrospective"])
    run.add_argument("--sensor-profile", choices=["all", "wrist"])
    run.add_argument("--rounds", type=int)
    run.add_argument("--hidden", type=int)
    run.add_argument("--byte-budget", type=int, help="most bytes of one upload")
    run.add_argument("--out", required=True)
    run.add_argument("--preset", choices=sorted(model.PRESETS), default="smoke")
    run.add_argument("--seeds", type=int, nargs="+", default=[0])
    run.add_argument("--folds", type=int)
    run.add_argument("--shard", default="0/1", help="k/n")
    run.add_argument("--attack", choices=loso.model.sketch.ATTACKS, default="clean")
    run.add_argument("--malicious", type=float, default=0.0)
    for name in ("merge", "summarize"):
        sub.add_parser(name).add_argument("--out", required=True)
    return p


def _frame(spark: SparkSession, a: argparse.Namespace):
    """The frame to run on: a table, recordings, or else the synthetic fixture; with provenance and a summary beside the results."""
    if a.frame:
        frame, manifest = spark.read.parquet(a.frame), {"source": a.frame, "synthetic": False}
    else:
        given = {"wesad_subjects": a.wesad_subjects and tuple(a.wesad_subjects), "cache_dir": a.cache_dir, "context_time_mode": a.context_time_mode, "sensor_profile": a.sensor_profile}
        config = data.data_config(a.wesad_dir, a.sleep_dir, **{name: value for name, value in given.items() if value})
        frame, manifest = data.load_data(spark, config, not (a.wesad_dir or a.sleep_dir))
    if a.datasets:
        frame = frame.filter(frame["dataset"].isin(*a.datasets))
    store.write_json(Path(a.out, "data_provenance.json"), manifest)
    rows = frame.groupBy("dataset", "task").agg(F.countDistinct("client_id").alias("subjects"), F.count("y").alias("windows"), F.avg("y").alias("positive_prevalence"))
    store.write_json(Path(a.out, "data_summary.json"), [r.asDict() for r in rows.orderBy("dataset").collect()])  # a row per dataset
    return frame


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        k, n = map(int, a.shard.split("/"))
        frame = _frame(spark, a)
        given = {"rounds": a.rounds, "hidden": a.hidden, "upload_cap": a.byte_budget}
        settings = model.preset(a.preset, **{name: value for name, value in given.items() if value is not None})
        ledger = loso.run_loso(spark, frame, a.out, settings, model.Scenario(a.attack, a.malicious), tuple(a.seeds), a.folds, (k, n))
        if n == 1:
            loso.summarize(spark, a.out)
        return int(any(x["status"] != "completed" for x in ledger))
    shards = sorted(Path(a.out).glob("completion_ledger_*of*.json"))
    counts = {p.stem.rpartition("of")[2] for p in shards}
    if len(counts) != 1 or len(shards) != int(counts.pop()):
        raise SystemExit("the set of shards is incomplete")
    ledger = [x for p in shards for x in json.loads(p.read_text())]
    keys = [(x["dataset"], x["client_id"], x["seed"], x["scenario"]) for x in ledger]
    if len(set(keys)) != len(keys):
        raise SystemExit("a job is in two shards")
    store.write_json(Path(a.out, "completion_ledger.json"), ledger)
    loso.summarize(spark, a.out)
    return int(any(x["status"] != "completed" for x in ledger))


if __name__ == "__main__":
    raise SystemExit(main())
