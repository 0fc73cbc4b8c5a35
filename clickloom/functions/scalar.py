"""Column expressions of the log: parsing, hashing, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MISSING


def hour_digits(hour: Column) -> Column:
    """Trimmed digits of an ``hour`` value, without a float's ``.0`` and filled up to eight."""
    s = F.regexp_replace(F.trim(hour.cast("string")), r"\.0$", "")
    return F.when(F.length(s) >= 8, s).otherwise(F.lpad(s, 8, "0"))


def hour_day(hour: Column) -> Column:
    """YYYYMMDD of an hour as YYMMDDHH or YYYYMMDDHH."""
    s = hour_digits(hour)
    return F.when(F.length(s) >= 10, F.substring(s, 1, 8)).otherwise(F.concat(F.lit("20"), F.substring(s, 1, 6))).cast("int")


def hour_of_day(hour: Column) -> Column:
    s = hour_digits(hour)
    return F.when(F.length(s) >= 10, F.substring(s, 9, 2)).otherwise(F.substring(s, 7, 2)).cast("smallint")


def number(c: Column) -> Column:
    """A number, or null where the value is none."""
    return c.try_cast("double")


def filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def ratio(k: Column, n: Column) -> Column:
    """k / n, or 0 where n is not positive."""
    return F.when(n > 0, k / F.when(n > 0, n)).otherwise(F.lit(0.0))


def clip(p: Column, low: float, high: float = 1.0) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def unit_hash(key: str, ident: Column) -> Column:
    """A stable number in [0, 1) of a key and an id: the first 32 bits of the MD5 of ``key|id``."""
    text = F.concat(F.lit(f"{key}|"), F.coalesce(ident.cast("string"), F.lit("__NULL__")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def adler32(c: Column) -> Column:
    """Adler-32 of a string's UTF-8 bytes."""
    digits = F.hex(F.encode(c, "UTF-8"))
    bytes_ = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    step = lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b"))
    return F.aggregate(bytes_, start, step, lambda s: s["b"] * 65536 + s["a"])


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k successes in n trials; (0, 0) for n <= 0."""
    m = F.when(n > 0, n).cast("double")
    p = k / m
    denominator = 1 + F.lit(z * z) / m
    center = (p + F.lit(z * z) / (2 * m)) / denominator
    margin = F.lit(z) * F.sqrt(p * (1 - p) / m + F.lit(z * z) / (4 * m * m)) / denominator
    zero = F.lit(0.0)
    return F.when(n > 0, F.greatest(zero, center - margin)).otherwise(zero), F.when(n > 0, F.least(F.lit(1.0), center + margin)).otherwise(zero)


def z_score(k: Column, n: Column, p0: Column) -> Column:
    m = F.when(n > 0, n).cast("double")
    return F.coalesce((k / m - p0) / F.sqrt(F.greatest(p0 * (1 - p0) / m, F.lit(1e-12))), F.lit(0.0))


def psi_term(p: Column, q: Column, eps: float) -> Column:
    a, b = clip(p, eps), clip(q, eps)
    return (b - a) * F.ln(b / a)
