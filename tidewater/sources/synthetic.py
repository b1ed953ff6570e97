"""A synthetic epoch frame: two datasets of participants with sticky labels and shifted, noisy features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import rng

NAMES = ("acc_f0", "acc_f1", "hr_f2", "hr_f3", "eda_f4", "eda_f5", "temp_f6", "temp_f7")
SCHEMA = "dataset string, task string, client_id string, y int, feature_start double, feature_end double, label_start double, label_end double, label_coverage double, label_purity double, declared_lookahead_s double, " + ", ".join(f"{n} double" for n in NAMES)


def fixture(spark: SparkSession, subjects: int = 8, windows: int = 100, seed: int = 101) -> DataFrame:
    """A chain that flips with probability 0.06; features of loadings, a participant's shift and noise. SLEEP lacks eda and temp."""

    def make(part: pd.DataFrame) -> pd.DataFrame:
        dataset, k = part["dataset"].iloc[0], int(part["k"].iloc[0])
        gen, load = rng("fixture", seed, dataset, k), rng("loadings", seed).choice([-1.0, 1.0], len(NAMES)) * 0.8
        y = (int(gen.integers(2)) + np.cumsum(gen.random(windows) < 0.06)) % 2
        x = np.outer(2 * y - 1, load) + gen.normal(0, 0.35, len(NAMES)) + gen.normal(0, 0.8, (windows, len(NAMES)))
        if dataset == "SLEEP":
            x[:, [i for i, n in enumerate(NAMES) if n.startswith(("eda", "temp"))]] = np.nan
        t = 30.0 * np.arange(windows)
        out = pd.DataFrame({"dataset": dataset, "task": "stress" if dataset == "WESAD" else "sleep", "client_id": f"{dataset}_FIX{k}", "y": y.astype("int32"), "feature_start": t - 60, "feature_end": t + 30, "label_start": t, "label_end": t + 30, "label_coverage": 1.0, "label_purity": 1.0, "declared_lookahead_s": 0.0})
        return pd.concat([out, pd.DataFrame(x, columns=NAMES)], axis=1)

    who = spark.createDataFrame([(d, k) for d in ("WESAD", "SLEEP") for k in range(subjects)], "dataset string, k int")
    made = who.groupBy("dataset", "k").applyInPandas(make, SCHEMA)
    return made.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in NAMES else F.col(c) for c in made.columns])
