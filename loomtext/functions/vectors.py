"""Numbers and arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.coalesce(F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)), F.lit(0.0)))))


def symmetric_kl(a: Column, b: Column) -> Column:
    """Half of KL(a||b) + KL(b||a); places where either isn't positive are skipped."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), (x.cast("double") - y.cast("double")) * F.ln(x.cast("double") / y.cast("double"))).otherwise(F.lit(0.0)))) / 2


def argsort(a: Column, descending: bool = False) -> Column:
    """Places, from 0, in the order of their values; equal values keep their order."""
    pairs = F.transform(a, lambda x, i: F.struct((-x if descending else x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)) - 1


def log_base(base: float, x: Column) -> Column:
    return F.ln(x) / F.ln(F.lit(float(base)))


def sha256_int(text: Column) -> Column:
    """The first four bytes of the SHA-256 digest as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
