"""Platt-like calibration of logits, participants weighing the same."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, sigmoid, softplus
from .preprocess import subject_weights

RIDGE, LOG_SLOPE, SHIFT, LIMIT = 0.005, 2.3, 5.0, 30.0


@dataclass
class Calibration:
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, z: Column) -> Column:
        return sigmoid(self.slope * clip(z, -LIMIT, LIMIT) + self.shift)


def fit(df: DataFrame, client: str, z: str, y: str, steps: int = 40) -> Calibration:
    """Least participant-weighted logistic loss plus a ridge on (log slope, shift), within bounds, by projected Newton
    steps; each step is one aggregate of five sums. Identity for a single class or a step that leads nowhere."""
    rows = subject_weights(df.select(client, clip(F.col(z), -LIMIT, LIMIT).alias("z"), F.col(y).alias("y")), client).cache()
    try:
        if rows.agg(F.countDistinct("y")).first()[0] < 2:
            return Calibration()

        def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            a = math.exp(v[0])
            t = a * F.col("z") + float(v[1])
            e, h, u = sigmoid(t) - F.col("y"), sigmoid(t) * (1 - sigmoid(t)), a * F.col("z")
            w = F.col("weight")
            r = rows.agg(F.sum(w), F.sum(w * (softplus(t) - F.col("y") * t)), F.sum(w * e * u), F.sum(w * e), F.sum(w * (h * u * u + e * u)), F.sum(w * h * u), F.sum(w * h)).first()
            n = r[0]
            loss = r[1] / n + RIDGE * float(v @ v)
            return loss, np.array([r[2], r[3]]) / n + 2 * RIDGE * v, np.array([[r[4], r[5]], [r[5], r[6]]]) / n + 2 * RIDGE * np.eye(2)

        v = np.zeros(2)
        bound = np.array([LOG_SLOPE, SHIFT])
        loss, grad, hess = at(v)
        for _ in range(steps):
            values, vectors = np.linalg.eigh(hess)
            step = -vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), 1e-3))
            size = 1.0
            while size > 1e-4:
                new = np.clip(v + size * step, -bound, bound)
                got = at(new)
                if got[0] < loss:
                    break
                size /= 2
            if size <= 1e-4 or abs(new - v).max() < 1e-9:
                break
            v, (loss, grad, hess) = new, got
        return Calibration(math.exp(v[0]), float(v[1]))
    finally:
        rows.unpersist()
