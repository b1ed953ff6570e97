"""Column expressions shared by the operators: cleaning, clipping, arrays, logistic pieces, named hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softplus(z: Column) -> Column:
    """ln(1 + e^z) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def seconds(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / F.lit(1e6)


def named_hash(*parts: Column | str | int) -> Column:
    """A reproducible order: the SHA-256 of the parts joined by colons, as hex."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def named_int(modulus: int, *parts: Column | str | int) -> Column:
    """An integer below modulus from the first eight hex digits of the named hash."""
    return F.conv(F.substring(named_hash(*parts), 1, 8), 16, 10).cast("long") % modulus


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_clip(a: Column, most: float) -> Column:
    size = norm(a)
    return F.when(size > most, F.transform(a, lambda x: x * (F.lit(most) / size))).otherwise(F.transform(a, lambda x: x.cast("double")))


def interval_overlap(lo: Column, hi: Column, start: Column, stop: Column) -> Column:
    return (lo < stop) & (hi > start)
