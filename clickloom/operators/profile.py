"""Profiles of a canonical log: rates, frequencies, coverage, out-of-vocabulary values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..schema import MISSING, OTHER

COVERAGE_KS = [1, 2, 3, 5, 10, 20, 50, 100, 200, 500, 1000, 1500, 2000, 3000, 5000]


def long_form(log: DataFrame, features: list[str]) -> DataFrame:
    """split, day, feature, value, label: a row per feature of each row."""
    return log.select("split", F.col("_day").alias("day"), F.col("_label_click").alias("label"), *features).unpivot(["split", "day", "label"], features, "feature", "value")


def cube(log: DataFrame, features: list[str]) -> DataFrame:
    """split, day, feature, value, n_rows, n_labeled, clicks: the one aggregate that the others start from."""
    return long_form(log, features).groupBy("split", "day", "feature", "value").agg(F.count(F.lit(1)).alias("n_rows"), F.count("label").alias("n_labeled"), F.sum(F.coalesce(F.col("label").cast("long"), F.lit(0))).alias("clicks"))


def _ctr(log: DataFrame, by: str, name: str) -> DataFrame:
    g = log.where("_label_click is not null").groupBy("split", F.col(by).cast("int").alias(name)).agg(F.count(F.lit(1)).alias("impressions"), F.sum(F.col("_label_click").cast("long")).alias("clicks"))
    return g.withColumn("ctr", ratio(F.col("clicks"), F.col("impressions")))


def ctr_by_day(log: DataFrame) -> DataFrame:
    return _ctr(log, "_day", "day")


def ctr_by_hod(log: DataFrame) -> DataFrame:
    return _ctr(log, "_hod", "hod")


def value_counts(c: DataFrame, split: str = "train") -> DataFrame:
    return c.where(F.col("split") == split).groupBy("feature", "value").agg(F.sum("n_rows").alias("count"), F.sum("clicks").alias("clicks"))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values of each feature with their rank; ties by value.

    The limit stands right on the rank, so Spark cuts each task's values to k before they meet
    (for k up to spark.sql.optimizer.windowGroupLimitThreshold).
    """
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("count"), "value"))).where(F.col("rank") <= k)


def _totals(counts: DataFrame) -> DataFrame:
    """feature, n, n_present (rows, and rows that are not missing): a row per feature."""
    return counts.groupBy("feature").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("value") != MISSING, F.col("count")).otherwise(0)).alias("n_present"))


def top_k(c: DataFrame, k: int = 50) -> DataFrame:
    """feature, rank, value, count, pct_of_train_rows."""
    counts = value_counts(c)
    return top_values(counts, k).join(_totals(counts), "feature").select("feature", "rank", "value", "count", (F.col("count") / F.col("n")).alias("pct_of_train_rows"))


def _coverage(c: DataFrame, k: int, exclude_missing: bool) -> DataFrame:
    """The first k ranks with their running share of the rows that are not missing."""
    counts = value_counts(c)
    used = counts.where(F.col("value") != MISSING) if exclude_missing else counts
    running = F.sum("count").over(Window.partitionBy("feature").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return top_values(used, k).withColumn("running", running).join(_totals(counts), "feature").withColumn("coverage", ratio(F.col("running"), F.col("n_present")))


def coverage(c: DataFrame, ks: list[int] | None = None, vocab_k: int = 2000, exclude_missing: bool = False) -> DataFrame:
    """feature, k, coverage_non_missing.

    The share may exceed 1: values that are missing count above, not below, unless excluded.
    """
    wanted = sorted({*(ks or COVERAGE_KS), vocab_k})
    return _coverage(c, wanted[-1], exclude_missing).where(F.col("rank").isin(wanted)).select("feature", F.col("rank").alias("k"), F.col("coverage").alias("coverage_non_missing"))


def missing_rate(c: DataFrame, split: str = "train") -> DataFrame:
    g = value_counts(c, split).groupBy("feature").agg(F.sum(F.when(F.col("value") == MISSING, F.col("count")).otherwise(0)).alias("m"), F.sum("count").alias("n"))
    return g.select("feature", ratio(F.col("m"), F.col("n")).alias("missing_rate_train"))


def min_k(c: DataFrame, vocab_k: int = 2000, max_k: int = 5000, exclude_missing: bool = False) -> DataFrame:
    """The first rank that covers 90, 95 and 99 percent, and what ``vocab_k`` values cover."""
    cov = _coverage(c, max_k, exclude_missing)
    first = {f"min_k@{p}": F.min(F.when(F.col("coverage") >= p / 100, F.col("rank"))) for p in (90, 95, 99)}
    out = cov.groupBy("feature").agg(F.max("rank").alias("max_k_used"), F.max(F.when(F.col("rank") <= vocab_k, F.col("coverage"))).alias("coverage@vocab_k"), *(e.alias(n) for n, e in first.items()))
    return out.withColumns({f"{n}_reached": F.col(f"`{n}`").isNotNull() for n in first})


def vocabulary(c: DataFrame, k: int) -> DataFrame:
    """feature, value of the k most frequent train values: k rows a feature at most."""
    return top_values(value_counts(c), k).select("feature", "value")


def out_of_vocabulary(c: DataFrame, vocab_k: int = 2000) -> DataFrame:
    """split, feature, vocab_k, oov_row_rate, oov_unique_est (exact): values of valid and test that the train vocabulary lacks.

    Missing values are not out of vocabulary, but count as rows.
    """
    counts = c.where("split <> 'train'").groupBy("split", "feature", "value").agg(F.sum("n_rows").alias("n"))
    known = counts.join(vocabulary(c, vocab_k).withColumn("known", F.lit(True)), ["feature", "value"], "left")
    out = F.col("known").isNull() & (F.col("value") != MISSING)
    g = known.groupBy("split", "feature").agg(F.sum(F.when(out, F.col("n")).otherwise(0)).alias("oov"), F.sum("n").alias("n"), F.count(F.when(out, F.lit(1))).alias("oov_unique_est"))
    return g.select("split", "feature", F.lit(vocab_k).alias("vocab_k"), ratio(F.col("oov"), F.col("n")).alias("oov_row_rate"), "oov_unique_est")


def binned(c: DataFrame, bins: DataFrame) -> DataFrame:
    """Add bin: the value where ``bins`` (feature, value) has it, else the tail bin."""
    return c.join(bins.withColumn("_hit", F.lit(True)), ["feature", "value"], "left").withColumn("bin", F.when(F.col("_hit"), F.col("value")).otherwise(OTHER)).drop("_hit")
