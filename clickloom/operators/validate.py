"""Checks of a canonical log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KEYS, MISSING


def schema_problems(log: DataFrame, features: list[str]) -> list[str]:
    """What is wrong with the columns, without reading a row."""
    types = {f.name: f.dataType for f in log.schema}
    return [f"no column {c}" for c in [*KEYS, *features] if c not in types] + [f"{c} is no string" for c in features if c in types and not isinstance(types[c], T.StringType)]


def violations(log: DataFrame) -> DataFrame:
    """split, n_rows, n_days, null_labels, bad_labels, null_ids, violations; labels may be null on test only."""
    label = F.col("_label_click")
    g = log.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_day").alias("n_days"), F.count(F.when(label.isNull(), 1)).alias("null_labels"),
        F.count(F.when(~label.isin(0, 1), 1)).alias("bad_labels"), F.count(F.when(F.col("_id").isNull(), 1)).alias("null_ids"),
    )
    return g.withColumn("violations", F.when(F.col("split") != "test", F.col("null_labels")).otherwise(0) + F.col("bad_labels") + F.col("null_ids"))


def most_missing(log: DataFrame, features: list[str], n: int = 10) -> DataFrame:
    """split, feature, missing_rate, place of the ``n`` features that miss most, in one pass."""
    from pyspark.sql import Window

    g = log.groupBy("split").agg(*(F.avg((F.col(f) == MISSING).cast("double")).alias(f) for f in features)).unpivot("split", features, "feature", "missing_rate")
    return g.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("missing_rate"), "feature"))).where(F.col("place") <= n)
