"""Helpers that all training-data operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The table survives lost executors, unlike a cache or a local checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound the rows and the bytes of one Arrow batch; the default of 10,000 rows is too much for long texts.

    Spark takes both from the session when a query runs, so they stay set; they are only ever lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
        now = int(number) << 10 * (" kmgtp".index(unit) if unit else 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def row_of(docs: DataFrame, *without: str) -> Column:
    """All columns of a row in one struct, so that no name of theirs can meet one that an operator uses."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in without))


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    For pure ASCII that is ``lower``, which works on bytes; other texts pay for ``translate``.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_bucket(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, size: str = "_n") -> DataFrame:
    """Left join rows with what is known of their group, where a group may hold a third of all rows.

    Groups of at least 1/1024 of the rows number 1024 at most, so they are broadcast; the
    rows of others meet their group in a shuffle join, where no key has more rows than
    that.  Rows that are settled by then are dealt out by ``spread`` (any text).
    """
    total = rows.count()
    rest_cols = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * 1024 >= total).select(*keys, *(F.col(c).alias(f"_hot{c}") for c in rest_cols))
    rest = groups.where(F.col(size) * 1024 < total).select(F.concat_ws("\x01", *(F.col(k).cast("string") for k in keys)).alias("_rkey"), *(F.col(c).alias(f"_rest{c}") for c in rest_cols))
    found = F.col(f"_hot{size}").isNotNull()
    return (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_lkey", F.when(found, F.concat(F.lit("\x02"), F.coalesce(spread, F.lit("")))).otherwise(F.concat_ws("\x01", *(F.col(k).cast("string") for k in keys))))
        .join(rest, F.col("_lkey") == F.col("_rkey"), "left")
        .select(*rows.columns, *(F.when(found, F.col(f"_hot{c}")).otherwise(F.col(f"_rest{c}")).alias(c) for c in rest_cols))
    )


def flagged(rows: DataFrame, keys: DataFrame, key: str, blocks: int = 1 << 16, words: int = 4) -> DataFrame:
    """Rows with _maybe: false only if their ``key`` is not in ``keys``.

    A Bloom filter in ``blocks`` rows of ``words`` 64-bit words (4 MB at any size of the input), which is all that is broadcast, however many keys there are;
    the more there are, the more other rows are true as well.
    """
    h = F.xxhash64(key)
    block, word, bit = F.pmod(h, F.lit(blocks)), F.pmod(F.shiftrightunsigned(h, 20), F.lit(words)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")
    one = F.expr("shiftleft(1L, _bit)")
    sets = keys.select(block.alias("_block"), word.alias("_word"), bit.alias("_bit")).groupBy("_block").agg(*(F.bit_or(F.when(F.col("_word") == w, one).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in range(words)))
    mask = F.coalesce(*(F.when(word == w, F.col(f"_w{w}")) for w in range(words)), F.lit(0).cast("long"))
    found = rows.withColumn("_block", block).withColumn("_bit", bit).join(F.broadcast(sets), "_block", "left")
    return found.select(*rows.columns, (mask.bitwiseAND(one) != 0).alias("_maybe"))


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): node, component (its smallest node).

    Large-star and small-star steps in turn until nothing changes; every round is written
    to the shared folder.  Only minima are aggregated, so a node with very many neighbours
    is combined before the shuffle and its joins can be split.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        new = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (new["n"], new["h"]) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = (new["n"], new["h"])
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
