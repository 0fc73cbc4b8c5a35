"""Cardinality and membership sketches as grouped tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import adler32


def hll_registers(long: DataFrame, by: list[str], value: str = "value", p: int = 14) -> DataFrame:
    """by, bucket, rank: the largest rank of 32-bit CRC hashes in each of 2**p buckets (empty ones have no row)."""
    if not 4 <= p <= 16:
        raise ValueError("p must be 4 to 16")
    h = F.crc32(F.encode(F.col(value), "UTF-8"))
    w = F.shiftrightunsigned(h, p)
    rank = F.when(w > 0, F.lit(32 - p + 1) - F.length(F.bin(w))).otherwise(F.lit(32 - p + 1))
    return long.groupBy(*by, h.bitwiseAND(F.lit((1 << p) - 1)).alias("bucket")).agg(F.max(rank.cast("int")).alias("rank"))


def hll_merge(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*by, "bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, by: list[str], p: int = 14) -> DataFrame:
    """by, estimate: raw estimate, or linear counting where it is small and registers are empty."""
    m = 1 << p
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    g = registers.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("n"))
    zeros = F.lit(m) - F.col("n")
    raw = F.lit(alpha * m * m) / (F.col("s") + zeros)
    small = (raw <= 2.5 * m) & (zeros > 0)
    return g.select(*by, F.when(small, F.lit(float(m)) * (math.log(m) - F.ln(F.greatest(zeros, F.lit(1)).cast("double")))).otherwise(raw).alias("estimate"))


def approx_distinct(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The built-in sketch for the same purpose."""
    return long.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, 14)).alias("estimate"))


def bloom_bits(values: DataFrame, by: list[str], value: str = "value", bits: int = 1 << 26) -> DataFrame:
    """by, bit: the set bits of a Bloom filter with two hashes."""
    if bits & (bits - 1):
        raise ValueError("the number of bits must be a power of two")
    v = F.col(value)
    both = F.array(F.crc32(F.encode(v, "UTF-8")).bitwiseAND(F.lit(bits - 1)), adler32(v).bitwiseAND(F.lit(bits - 1)))
    return values.select(*by, F.explode(both).alias("bit")).distinct()


def bloom_contains(values: DataFrame, filter_bits: DataFrame, by: list[str], value: str = "value", bits: int = 1 << 26) -> DataFrame:
    """Distinct (by, value) with whether the filter may hold the value."""
    v = F.col(value)
    d = values.select(*by, value).distinct().withColumns({"_b1": F.crc32(F.encode(v, "UTF-8")).bitwiseAND(F.lit(bits - 1)), "_b2": adler32(v).bitwiseAND(F.lit(bits - 1))})
    for b in ("_b1", "_b2"):
        d = d.join(filter_bits.select(*by, F.col("bit").alias(b), F.lit(True).alias(f"{b}_on")), [*by, b], "left")
    return d.select(*by, value, (F.col("_b1_on").isNotNull() & F.col("_b2_on").isNotNull()).alias("may_contain"))
