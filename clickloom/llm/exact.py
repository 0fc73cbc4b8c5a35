"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, written

KEY = ["_sha", "_chk", "_len"]


def normal(text_col: str) -> Column:
    """The text that is compared: A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, SHA-256 of the normalised text, and two independent checks of it."""
    return (
        docs.select(F.col(id_col).cast("long").alias("_id"), normal(text_col).alias("_norm"))
        .select(
            "_id",
            F.unhex(F.sha2("_norm", 256)).alias("_sha"),
            F.xxhash64("_norm").alias("_chk"),
            F.octet_length("_norm").alias("_len"),
        )
    )


def merge_runs(rows: DataFrame, runs: int = 64, keep: str = "largest") -> DataFrame:
    """Merge sorted digest runs in binomial rounds until one run is left.

    Each input partition belongs to one of ``runs`` runs (a power of two); duplicates inside a
    partition collapse before anything is shuffled, and the partitions of a run are merged into
    one entry per digest.  In round k, run r and run r + 2**k exchange: their entries are dealt out by
    (merged run, digest), sorted there, and of neighbours with equal digests one goes on, with the
    better identifier and both sizes.  So a task never holds a whole run, and a digest has two
    rows at most in any round, however many documents share it.  Entries merge only if digest, check hash and byte
    length all agree (the verification), and the retained identifier is taken anew at
    every level.  Returns KEY, _keep, _n.
    """
    if runs & (runs - 1):
        raise ValueError("runs must be a power of two")
    best, first = (F.max, F.col("_keep").desc_nulls_last()) if keep == "largest" else (F.min, F.col("_keep").asc_nulls_last())
    level = (
        rows.withColumn("_run", F.pmod(F.spark_partition_id(), F.lit(runs)))
        .groupBy("_run", *KEY)
        .agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    merged = Window.partitionBy("_run", *KEY).orderBy(first)  # a sort that the optimiser can't drop
    for k in range(runs.bit_length() - 1):
        met = level.withColumn("_run", F.col("_run").bitwiseAND(F.lit(~(1 << k))))
        level = (
            met.withColumn("_place", F.row_number().over(merged))
            .withColumn("_n", F.col("_n") + F.coalesce(F.lead("_n").over(merged), F.lit(0)))
            .where("_place = 1")
            .drop("_place")
        )
    return level.drop("_run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Returns per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts form one group.  A row that repeats a
    ``doc_id`` counts as one more copy, and is kept if its id is the one that stays.  A
    null id never stays unless its whole group has null ids.  An empty table gives an
    empty result.  Other columns of the input are not read.

    The way back from groups to documents is two joins.  Digests that at least 1/1024 of
    all rows share number 1024 at most, so those are broadcast; all others have fewer rows
    than that each, and meet in a shuffle join.
    """
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    groups = written(merge_runs(rows, keep=keep).where("_n > 1"), "digest-groups")
    total = rows.count()
    hot = groups.where(F.col("_n") * 1024 >= total).select(*KEY, F.col("_keep").alias("_hot_keep"), F.col("_n").alias("_hot_n"))
    rest = groups.where(F.col("_n") * 1024 < total).select(F.col("_sha").alias("_k"), F.col("_chk").alias("_c"), F.col("_len").alias("_l"), "_keep", "_n")
    alone = F.encode(F.coalesce(F.col("_id"), F.lit(0)).cast("string"), "UTF-8")  # spreads the rows that are settled already
    out = (
        rows.join(F.broadcast(hot), KEY, "left")
        .withColumn("_own", F.when(F.col("_hot_n").isNotNull(), alone).otherwise(F.col("_sha")))
        .join(rest, (F.col("_own") == F.col("_k")) & (F.col("_chk") == F.col("_c")) & (F.col("_len") == F.col("_l")), "left")
    )
    size = F.coalesce("_hot_n", "_n", F.lit(1))
    keep_id = F.when(F.col("_hot_n").isNotNull(), F.col("_hot_keep")).when(F.col("_n").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias("doc_id"),
        keep_id.alias("keep_id"),
        size.cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


SQL = """
WITH n AS (
  SELECT doc_id,
         sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (norm)
"""
