"""Rates by value and by pairs of values, with their significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, wilson, z_score
from ..schema import OTHER
from .profile import binned, value_counts, vocabulary


def ctr_by_value(c: DataFrame, top: int = 2000, thresholds: tuple[int, ...] = (10_000, 50_000)) -> DataFrame:
    """Rates of the most frequent train values and the tail: lift, Wilson interval, z-score and flags.

    Rows without a label count as impressions without a click.
    """
    b = binned(c.where("split = 'train'"), vocabulary(c, top)).groupBy("feature", F.col("bin").alias("value")).agg(F.sum("n_rows").alias("imps"), F.sum("clicks").alias("clicks"))
    # the overall rate is that of any one feature's values
    whole = Window.partitionBy("feature")
    p0 = F.sum("clicks").over(whole) / F.greatest(F.sum("imps").over(whole), F.lit(1))
    b = b.withColumn("p0", p0).where("imps > 0").withColumn("ctr", ratio(F.col("clicks"), F.col("imps")))
    low, high = wilson(F.col("clicks"), F.col("imps"))
    z = z_score(F.col("clicks"), F.col("imps"), F.col("p0"))
    flags = {f"pass_min_imps_{t}": F.col("imps") >= t for t in thresholds}
    return b.withColumns({"lift_vs_global": F.col("ctr") / F.greatest("p0", F.lit(1e-12)), "wilson_lo": low, "wilson_hi": high, "zscore_vs_global": z} | flags).withColumn("is_suspicious", (F.col("imps") >= thresholds[-1]) & (F.abs("zscore_vs_global") >= 8)).drop("p0").orderBy("feature", F.desc("imps"), "value")


def pair_cells(log: DataFrame, c: DataFrame, pairs: list[tuple[str, str]], k: int = 50) -> DataFrame:
    """pair, feature_a, feature_b, a_bin, b_bin, imps, clicks over train.

    All pairs are counted in one scan, over the raw values; these are binned after that.
    """
    pairs = [p for p in pairs if p[0] in log.columns and p[1] in log.columns]
    if not pairs:
        return log.sparkSession.createDataFrame([], "pair string, feature_a string, feature_b string, a_bin string, b_bin string, imps long, clicks long")
    values = F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))
    label = F.coalesce(F.col("_label_click").cast("long"), F.lit(0)).alias("label")
    g = log.where("split = 'train'").select(label, F.explode(values).alias("v")).groupBy("v.feature_a", "v.feature_b", "v.a", "v.b").agg(F.count(F.lit(1)).alias("imps"), F.sum("label").alias("clicks"))
    top = vocabulary(c, k)
    for x in "ab":
        own = top.select(F.col("feature").alias(f"feature_{x}"), F.col("value").alias(x), F.lit(True).alias(f"_{x}"))
        g = g.join(own, [f"feature_{x}", x], "left").withColumn(f"{x}_bin", F.when(F.col(f"_{x}"), F.col(x)).otherwise(OTHER))
    pair = F.concat("feature_a", F.lit("__X__"), "feature_b").alias("pair")
    return g.groupBy(pair, "feature_a", "feature_b", "a_bin", "b_bin").agg(F.sum("imps").alias("imps"), F.sum("clicks").alias("clicks"))


def pair_interactions(cells: DataFrame) -> DataFrame:
    """Joint and expected rates of every cell."""
    w, wa, wb = Window.partitionBy("pair"), Window.partitionBy("pair", "a_bin"), Window.partitionBy("pair", "b_bin")
    total = lambda c, over: F.sum(c).over(over)
    x = cells.withColumns({"n": total("imps", w), "k": total("clicks", w), "ctr_a": ratio(total("clicks", wa), total("imps", wa)), "ctr_b": ratio(total("clicks", wb), total("imps", wb))})
    x = x.withColumn("p0", F.col("k") / F.greatest("n", F.lit(1))).withColumn("ctr", ratio(F.col("clicks"), F.col("imps")))
    p0 = F.greatest("p0", F.lit(1e-12))
    x = x.withColumns({"lift_joint": F.col("ctr") / p0, "lift_over_marginal": F.col("ctr") / F.greatest(F.col("ctr_a") * F.col("ctr_b") / p0, F.lit(1e-12))})
    return x.withColumn("log_interaction", F.ln(F.greatest("lift_over_marginal", F.lit(1e-12))))


def pair_combos(cells: DataFrame, min_imps: int = 10_000) -> DataFrame:
    keep = ["pair", "feature_a", "feature_b", "a_bin", "b_bin", "imps", "clicks", "ctr", "lift_joint", "lift_over_marginal", "log_interaction"]
    return pair_interactions(cells).where(F.col("imps") >= min_imps).select(*keep).orderBy("pair", F.desc("log_interaction"), "a_bin", "b_bin")


def pair_summary(cells: DataFrame, min_imps: int = 10_000) -> DataFrame:
    """Mutual information of the click with the cell (nats), and the cell that stands out.

    The first cell by (a_bin, b_bin) stands until an eligible one has a strictly larger
    absolute log interaction.
    """
    x = pair_interactions(cells)
    px, p1 = F.col("imps") / F.col("n"), F.col("p0")
    px1, px0 = F.col("clicks") / F.col("n"), (F.col("imps") - F.col("clicks")) / F.col("n")
    term = lambda joint, y: F.when(joint > 0, joint * F.ln(joint / F.greatest(px * y, F.lit(1e-12)))).otherwise(0.0)
    cell = F.struct("a_bin", "b_bin", "imps", "log_interaction")
    strength = F.abs("log_interaction")
    ok = F.col("imps") >= min_imps
    g = x.groupBy("pair", "feature_a", "feature_b").agg(
        F.sum(term(px1, p1) + term(px0, 1 - p1)).alias("mi_y_combo"),
        F.count(F.lit(1)).alias("n_combos"),
        F.min_by(cell, F.struct("a_bin", "b_bin")).alias("first"),
        F.max(F.when(ok, strength)).alias("most"),
        F.min(F.when(ok, F.struct((-strength).alias("s"), F.col("a_bin"), F.col("b_bin"), F.col("imps"), F.col("log_interaction")))).alias("top"),
    )
    wins = F.coalesce(F.col("most") > F.abs("first.log_interaction"), F.lit(False))
    best = lambda f: F.when(wins, F.col(f"top.{f}")).otherwise(F.col(f"first.{f}"))
    return g.select("pair", "feature_a", "feature_b", "mi_y_combo", "n_combos", best("a_bin").alias("best_combo_a"), best("b_bin").alias("best_combo_b"), best("imps").alias("best_combo_imps"), best("log_interaction").alias("best_combo_log_interaction")).orderBy(F.desc("mi_y_combo"), "pair")
