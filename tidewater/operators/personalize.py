"""Personal biases of participants, shrunk and gated by leave-one-out loss on their support rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics


def nll(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_bias(z: np.ndarray, y: np.ndarray, ridge: float) -> float:
    """The bias in (-3, 3) of least summed logistic loss and half a ridge: a root of the monotone gradient, by bisection."""
    lo, hi = -3.0, 3.0
    slope = lambda b: float(np.sum(1 / (1 + np.exp(-(z + b))) - y)) + ridge * b
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def shrunk_bias(z: np.ndarray, y: np.ndarray, ridge: float, k: float = 15.0, cap: float = 1.0) -> float:
    return float(np.clip(fit_bias(z, y, ridge) * len(z) / (len(z) + k), -cap, cap)) if len(z) else 0.0


def bias_helps(z: np.ndarray, y: np.ndarray, ridge: float, margin: float = 0.03, cap: float = 1.0) -> tuple[bool, float, float]:
    """Whether biases fitted without each row lower the mean loss by margin, with both losses; never below eight rows."""
    if len(z) < 8:
        return False, float("nan"), float("nan")
    base = nll(z, y)
    keep = ~np.eye(len(z), dtype=bool)
    left = float(np.mean([nll(z[i : i + 1] + shrunk_bias(z[keep[i]], y[keep[i]], ridge, cap=cap), y[i : i + 1]) for i in range(len(z))]))
    return left < base * (1 - margin), base, left


def personal_rows(df: DataFrame, threshold: float, ridge: float = 5.0, margin: float = 0.03, cap: float = 1.0) -> DataFrame:
    """df (client_id, z, y, part): for each client and arm (shared, personalised) the query metrics and what the gate saw.

    The gate wants 5 support rows, 10 query rows, 4 of the support's minority, logits that spread by 0.05, and the
    leave-one-out gain. A client's support (its first rows) meets in one task; its query rows are scored in place.
    """

    def gate(part: pd.DataFrame) -> pd.DataFrame:
        z, y = part["z"].to_numpy(float), part["y"].to_numpy(float)
        few = int(min((y == 0).sum(), (y == 1).sum()))
        ok = len(z) >= 5 and few >= 4 and z.std() >= 0.05
        helps, shared, left = bias_helps(z, y, ridge, margin, cap) if ok else (False, float("nan"), float("nan"))
        bias = shrunk_bias(z, y, ridge, cap=cap) if helps else 0.0
        finite = lambda x: None if np.isnan(x) else x
        return pd.DataFrame([(part["client_id"].iloc[0], len(z), few, float(z.std()), bool(ok), bool(helps), bias, finite(shared), finite(left))], columns=["client_id", "support_n", "support_minority_n", "support_logit_sd", "adaptation_eligible", "adaptation_gate_passed", "personal_bias", "loo_nll_shared", "loo_nll_personalised"])

    seen = df.filter("part = 'support'").select("client_id", "z", "y").groupBy("client_id").applyInPandas(gate, "client_id string, support_n int, support_minority_n int, support_logit_sd double, adaptation_eligible boolean, adaptation_gate_passed boolean, personal_bias double, loo_nll_shared double, loo_nll_personalised double")
    queries = df.filter("part = 'query'")
    n = queries.groupBy("client_id").agg(F.count(F.lit(1)).alias("query_n"))
    rows = queries.join(seen, "client_id").join(n, "client_id").withColumn("personal_bias", F.when(F.col("query_n") >= 10, F.col("personal_bias")).otherwise(0.0))
    arms = rows.withColumn("arm", F.explode(F.array(F.lit("shared"), F.lit("personalised")))).withColumn("p", 1 / (1 + F.exp(-(F.col("z") + F.when(F.col("arm") == "personalised", F.col("personal_bias")).otherwise(0.0)))))
    scored = metrics.confusion(arms, ["client_id", "arm"], threshold).select("client_id", "arm", "n", "macro_f1", "accuracy", "nll", "brier")
    return scored.join(seen, "client_id").join(n, "client_id")
