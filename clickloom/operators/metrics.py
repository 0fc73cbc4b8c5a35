"""Offline metrics of scored rows (y_true, y_pred), overall or by group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, unit_hash

ALL = "__ALL__"
SLICES = 1 << 16


def _grouped(scored: DataFrame, group: str | None) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit(ALL)
    return scored.select(g.alias("group"), F.col("y_true").cast("int").alias("y"), F.col("y_pred").cast("double").alias("p")).where("y is not null and p is not null")


def score_counts(scored: DataFrame, group: str | None = None) -> DataFrame:
    """group, p, pos, neg: rows by distinct score.  All metrics below start from it, so one scan and one shuffle serve them."""
    return _grouped(scored, group).groupBy("group", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def _running(c: DataFrame) -> DataFrame:
    """Add pos_below, neg_below (rows with a smaller score) and the group's all_pos, all_neg.

    The sums run in two levels, so that no group has to be ordered by one task: the totals of 2**16 equal
    slices of the scores first (at most that many rows a group), then the scores inside each slice.
    """
    sliced = c.withColumn("slice", F.floor(clip(F.col("p"), 0.0) * SLICES))  # a power of two: exact, so the order is kept
    total = sliced.groupBy("group", "slice").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before, whole = Window.partitionBy("group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("group")
    base = total.select("group", "slice", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_base") for x in ("pos", "neg")), *(F.sum(x).over(whole).alias(f"all_{x}") for x in ("pos", "neg")))
    inside = Window.partitionBy("group", "slice").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.withColumns({f"{x}_in": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in ("pos", "neg")}).join(base, ["group", "slice"])
    return joined.withColumns({f"{x}_below": F.col(f"{x}_base") + F.col(f"{x}_in") for x in ("pos", "neg")})


def _separation(c: DataFrame) -> DataFrame:
    """group, auc, gini, ks: what the order of the scores gives, in one pass over it."""
    share = lambda x: F.try_divide((F.col(f"{x}_below") + F.col(x)).cast("double"), F.col(f"all_{x}"))
    ordered = _running(c).withColumns({"u": F.col("pos") * (F.col("neg_below") + F.col("neg") / 2), "gap": F.abs(share("pos") - share("neg"))})
    g = ordered.groupBy("group").agg(F.sum("u").alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("gap").alias("ks"))
    a = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.try_divide(F.col("u"), F.col("pos").cast("double") * F.col("neg")))
    return g.select("group", a.alias("auc"), (2 * a - 1).alias("gini"), "ks")


def _logloss(c: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    return c.groupBy("group").agg((-F.sum(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1 - p)) / F.sum(F.col("pos") + F.col("neg"))).alias("logloss"))


def _reliability(c: DataFrame, n_bins: int) -> DataFrame:
    b, n = F.least(F.floor(clip(F.col("p"), 0.0) * n_bins), F.lit(n_bins - 1)).cast("int"), F.col("pos") + F.col("neg")
    return c.groupBy("group", b.alias("bin")).agg(F.sum(n).alias("n"), (F.sum(F.col("p") * n) / F.sum(n)).alias("mean_predicted"), (F.sum("pos") / F.sum(n)).alias("mean_actual"))


def _calibration(c: DataFrame, n_bins: int) -> DataFrame:
    gap = F.abs(F.col("mean_predicted") - F.col("mean_actual"))
    return _reliability(c, n_bins).groupBy("group").agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def auc(scored: DataFrame, group: str | None = None) -> DataFrame:
    """group, auc, gini: Mann-Whitney with mid-ranks; null where a group has one class only."""
    return _separation(score_counts(scored, group)).select("group", "auc", "gini")


def ks(scored: DataFrame, group: str | None = None) -> DataFrame:
    """group, ks: the largest gap between the score distributions of the two classes."""
    return _separation(score_counts(scored, group)).select("group", "ks")


def logloss(scored: DataFrame, group: str | None = None) -> DataFrame:
    return _logloss(score_counts(scored, group))


def reliability(scored: DataFrame, n_bins: int = 10, group: str | None = None) -> DataFrame:
    """group, bin, n, mean_predicted, mean_actual over bins of equal width."""
    return _reliability(score_counts(scored, group), n_bins)


def calibration(scored: DataFrame, n_bins: int = 10, group: str | None = None) -> DataFrame:
    """group, ece, mce."""
    return _calibration(score_counts(scored, group), n_bins)


def evaluate(scored: DataFrame, group: str | None = None, n_bins: int = 10) -> DataFrame:
    """All metrics, a row per group."""
    c = score_counts(scored, group)
    return _separation(c).join(_logloss(c), "group").join(_calibration(c, n_bins), "group")


#: Groups of rows, by a hash of their id, that get one weight in a replicate, so that weights are drawn for
#: CELLS x replicates, however many rows there are.
CELLS, REPLICATES = 1024, 10_000


def _cell(ident: str, key: str) -> Column:
    return F.floor(unit_hash(key, F.col(ident)) * CELLS).cast("int")


def _weights(spark: SparkSession, b: int, key: str) -> DataFrame:
    """cell, replicate, weight (1 or more): Poisson(1) from a hash, so that any engine draws the same."""
    drawn = spark.range(0, CELLS, 1, min(CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")))).select(F.col("id").cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("replicate"))
    u = F.col("u")
    # inverse distribution function of Poisson(1)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        weight = F.when(u < steps[k], F.lit(k)).otherwise(weight)
    ident = F.concat_ws(":", F.col("cell").cast("string"), F.col("replicate").cast("string"))
    return drawn.withColumn("u", unit_hash(key, ident)).select("cell", "replicate", weight.alias("weight")).where("weight > 0")


def _replicate_means(rows: DataFrame, ident: str, x: Column, b: int, key: str) -> DataFrame:
    """replicate, m: weighted means.  Rows are summed by cell first, so CELLS rows meet the weights."""
    cells = rows.select(_cell(ident, key).alias("cell"), x.cast("double").alias("x")).where("x is not null").groupBy("cell").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    drawn = _weights(rows.sparkSession, b, key).join(F.broadcast(cells), "cell")
    return drawn.groupBy("replicate").agg((F.sum(F.col("x") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("m"))


def _interval(replicates: DataFrame, level: float) -> DataFrame:
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    return replicates.agg(F.percentile("m", low).alias("lower"), F.percentile("m", high).alias("upper"))


def _p_value(replicates: DataFrame) -> DataFrame:
    return replicates.agg(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p_value"))


def bootstrap_mean(rows: DataFrame, ident: str, value: str, b: int = REPLICATES, level: float = 0.95, key: str = "bootstrap_v1") -> DataFrame:
    """estimate, lower, upper: percentile interval of a weighted mean, such as log loss or a rate.

    Rows are drawn by cell (CELLS groups by a hash of their id), so the cost besides one scan does not depend on their number.
    """
    interval = _interval(_replicate_means(rows, ident, F.col(value), b, key), level)
    return rows.agg(F.avg(F.col(value).cast("double")).alias("estimate")).join(F.broadcast(interval), F.lit(True))  # one row each


#: Metrics of a table of counts (group, p, pos, neg) as (group, value); any function of that form is a metric.
METRICS = {
    "auc": lambda c: _separation(c).select("group", F.col("auc").alias("value")),
    "gini": lambda c: _separation(c).select("group", F.col("gini").alias("value")),
    "ks": lambda c: _separation(c).select("group", F.col("ks").alias("value")),
    "logloss": lambda c: _logloss(c).select("group", F.col("logloss").alias("value")),
    "ece": lambda c: _calibration(c, 10).select("group", F.col("ece").alias("value")),
}


def _replicate_metric(scored: DataFrame, ident: str, metric: Callable[[DataFrame], DataFrame], b: int, key: str, score: str) -> DataFrame:
    """replicate, m of a metric: each replicate is a group of weighted counts by distinct score."""
    rows = scored.select(_cell(ident, key).alias("cell"), F.col("y_true").cast("int").alias("y"), F.col(score).cast("double").alias("p")).where("y is not null and p is not null")
    counts = rows.groupBy("cell", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    drawn = counts.join(_weights(scored.sparkSession, b, key), "cell")
    weighted = drawn.groupBy(F.col("replicate").cast("string").alias("group"), "p").agg(*(F.sum(F.col(x) * F.col("weight")).alias(x) for x in ("pos", "neg")))
    return metric(weighted).select(F.col("group").cast("int").alias("replicate"), F.col("value").alias("m")).where("m is not null")


def _metric_of(scored: DataFrame, metric: Callable[[DataFrame], DataFrame], score: str) -> DataFrame:
    return metric(score_counts(scored.select("y_true", F.col(score).alias("y_pred")))).select("value")


def bootstrap(scored: DataFrame, ident: str, metric: str | Callable[[DataFrame], DataFrame] = "auc", b: int = 200, level: float = 0.95, key: str = "bootstrap_v1") -> DataFrame:
    """estimate, lower, upper of any metric of (y_true, y_pred): a name in METRICS or a function of counts by score.

    Unlike a mean, such a metric needs the counts by distinct score (and cell) in every replicate, so
    the work is their number times ``b``; bin the scores first where they are very many.
    Replicates in which the metric is undefined are left out.
    """
    f = METRICS[metric] if isinstance(metric, str) else metric
    interval = _interval(_replicate_metric(scored, ident, f, b, key, "y_pred"), level)
    return _metric_of(scored, f, "y_pred").withColumnRenamed("value", "estimate").join(F.broadcast(interval), F.lit(True))


def significance(rows: DataFrame, ident: str, a: str, b: str, n: int = REPLICATES, alpha: float = 0.05, key: str = "bootstrap_v1", metric: str | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """difference, p_value, significant of a against b, by the share of replicates on either side of zero.

    Without a metric, of the mean of a - b; with one, a and b are two scores of the same y_true rows.
    """
    if metric is None:
        d = (F.col(a) - F.col(b)).cast("double")
        p, difference = _p_value(_replicate_means(rows, ident, d, n, key)), rows.agg(F.avg(d).alias("difference"))
    else:
        f = METRICS[metric] if isinstance(metric, str) else metric
        x, y = (_replicate_metric(rows, ident, f, n, key, c) for c in (a, b))
        p = _p_value(x.join(y.withColumnRenamed("m", "other"), "replicate").select((F.col("m") - F.col("other")).alias("m")))
        one, two = (_metric_of(rows, f, c) for c in (a, b))
        difference = one.withColumnRenamed("value", "one").join(F.broadcast(two.withColumnRenamed("value", "two")), F.lit(True)).select((F.col("one") - F.col("two")).alias("difference"))
    return difference.join(F.broadcast(p), F.lit(True)).withColumn("significant", F.col("p_value") < alpha)


def offline_online_gap(offline: DataFrame, online: DataFrame) -> DataFrame:
    """metric, offline, online, gap, ratio of two tables (metric, value)."""
    j = offline.select("metric", F.col("value").alias("offline")).join(online.select("metric", F.col("value").alias("online")), "metric")
    return j.withColumns({"gap": F.col("offline") - F.col("online"), "ratio": F.try_divide("offline", "online")})


def temperature(scored: DataFrame, grid: tuple[float, ...] = tuple(round(0.5 + 0.05 * i, 2) for i in range(51))) -> DataFrame:
    """temperature, logloss: the divisor of the logit with the smallest log loss, over a grid in one pass over the distinct scores."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    z = score_counts(scored).select("pos", "neg", F.ln(p / (1 - p)).alias("z"), F.explode(F.array(*map(F.lit, grid))).alias("temperature"))
    q = 1 / (1 + F.exp(-F.col("z") / F.col("temperature")))
    q = F.least(F.greatest(q, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.sum(F.col("pos") * F.ln(q) + F.col("neg") * F.ln(1 - q)) / F.sum(F.col("pos") + F.col("neg"))
    return z.groupBy("temperature").agg(loss.alias("logloss")).orderBy("logloss", "temperature").limit(1)
