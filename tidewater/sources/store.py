"""Content-addressed Parquet stores and atomic JSON: caches of frames, checkpoints, artifacts, run tables."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class _Plain(json.JSONEncoder):
    """Arrays and sets as lists, other objects by their names; numbers that are not finite as null."""

    def default(self, o):
        if isinstance(o, (set, frozenset)):
            return sorted(o, key=repr)
        return o.tolist() if hasattr(o, "tolist") else str(o)

    def iterencode(self, o, _one_shot=False):
        return super().iterencode(_finite(json.loads(json.dumps(o, default=self.default))), _one_shot)


def _finite(x):
    match x:
        case dict():
            return {k: _finite(v) for k, v in x.items()}
        case list():
            return [_finite(v) for v in x]
        case float() if not math.isfinite(x):
            return None
    return x


def plain_text(x, **style) -> str:
    return json.dumps(x, cls=_Plain, sort_keys=True, **style)


def digest(x) -> str:
    return hashlib.sha256(plain_text(x).encode()).hexdigest()


def read_json(path: str | Path):
    return json.loads(Path(path).read_text())


def write_json(path: str | Path, x) -> None:
    """Written beside its place and moved there, so readers see all or nothing."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as f:
        f.write(plain_text(x, indent=1))
    os.replace(name, path)


def cached(spark: SparkSession, root: str, key, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame stored under the digest of key, made and written first if it is not there."""
    path = f"{root}/{digest(key)}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # Spark has one exception for all failures of analysis
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, or no rows where there is none."""
    if not list(Path(path).parent.glob(Path(path).name)):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)
