"""Drift of a log: population stability by feature and day, and new values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, psi_term, ratio
from ..schema import MISSING, OTHER
from .profile import binned, vocabulary


def _shares(c: DataFrame, k: int) -> DataFrame:
    """feature, split, day, bin, p (train share), q (share of the day), n_rows; a row for every bin, also empty ones."""
    top = vocabulary(c, k)
    b = binned(c, top)
    train = b.where("split = 'train'").groupBy("feature", "bin").agg(F.sum("n_rows").alias("n"))
    train_n = train.groupBy("feature").agg(F.sum("n").alias("train_n"))
    days = b.where("split <> 'train'").groupBy("split", "day", "feature", "bin").agg(F.sum("n_rows").alias("m"))
    day_n = days.groupBy("split", "day", "feature").agg(F.sum("m").alias("n_rows"))
    extra = top.select("feature").distinct().withColumn("bin", F.explode(F.array(F.lit(OTHER), F.lit(MISSING))))
    bins = top.select("feature", F.col("value").alias("bin")).union(extra).distinct()
    scaffold = day_n.join(bins, "feature")  # days x bins of one feature: k + 2 a day
    out = scaffold.join(train, ["feature", "bin"], "left").join(days, ["split", "day", "feature", "bin"], "left").join(train_n, "feature")
    return out.select("feature", "split", "day", "bin", (F.coalesce("n", F.lit(0)) / F.col("train_n")).alias("p"), (F.coalesce("m", F.lit(0)) / F.col("n_rows")).alias("q"), "n_rows")


def psi_by_field_day(c: DataFrame, k: int = 50, eps: float = 1e-6) -> DataFrame:
    """feature, split, day, psi, n_rows, in that order of rows."""
    return _shares(c, k).groupBy("feature", "split", "day").agg(F.sum(psi_term(F.col("p"), F.col("q"), eps)).alias("psi"), F.first("n_rows").alias("n_rows")).orderBy("feature", "split", "day")


def psi_components(c: DataFrame, k: int = 50, eps: float = 1e-10) -> DataFrame:
    """feature, split, day, bin, p, q, psi_contrib (clipped shares)."""
    s = _shares(c, k)
    return s.select("feature", "split", "day", "bin", clip(F.col("p"), eps).alias("p"), clip(F.col("q"), eps).alias("q"), psi_term(F.col("p"), F.col("q"), eps).alias("psi_contrib"))


def novelty(c: DataFrame) -> DataFrame:
    """scope, split, day, feature, new_row_rate, n_rows.

    On train days: values first seen that day over the day's rows.  On later days: rows
    whose value train never has, over the day's rows.  Missing values are never new.
    One scan: the first train day of a value is a window over its rows of the cube.
    """
    present = F.col("value") != MISSING
    train = F.col("split") == "train"
    first = F.min(F.when(train & present, F.col("day"))).over(Window.partitionBy("feature", "value"))
    seen = c.withColumn("_first", first)
    new = F.when(~present, 0).when(train, (F.col("day") == F.col("_first")).cast("long")).when(F.col("_first").isNull(), F.col("n_rows")).otherwise(0)
    g = seen.groupBy("split", "day", "feature").agg(F.sum(new).alias("new"), F.sum("n_rows").alias("n_rows"))
    scope = F.when(train, "train_incremental").otherwise("vs_full_train")
    return g.select(scope.alias("scope"), "split", "day", "feature", ratio(F.col("new"), F.col("n_rows")).alias("new_row_rate"), "n_rows")
