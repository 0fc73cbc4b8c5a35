"""Whole jobs: materialize a log, profile it, look for drift, replay auctions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import auction, drift, profile, significance
from ..sources.clicklog import build_source, read_auctions, read_canonical

# The pairs whose interaction is reported by default.
DEFAULT_PAIRS = [("site_id", "app_id"), ("site_domain", "app_domain"), ("app_id", "device_model"), ("C14", "C17")]


def materialize(spark: SparkSession, config: dict, out_root: str) -> dict[str, int]:
    """Write the canonical log by split and day, replacing the partitions it has rows for; rows by split.

    Rows are rebalanced by split and day: adaptive execution cuts a day that is larger than its advisory
    size into several files, and puts small days into one task.
    """
    log = build_source(config).load(spark)
    dealt = log.withColumn("day", F.col("_day")).hint("rebalance", "split", "day")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("split", "day").parquet(out_root)
    return {r["split"]: r["rows"] for r in files_index(spark, out_root).groupBy("split").agg(F.sum("rows").alias("rows")).collect()}


def files_index(spark: SparkSession, root: str) -> DataFrame:
    """split, day, file, rows of a materialized log."""
    return spark.read.parquet(root).groupBy("split", "day", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def write_tables(tables: dict[str, DataFrame], out: str) -> list[str]:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return sorted(tables)


def profile_tables(log: DataFrame, features: list[str], vocab_k: int = 2000, cube: DataFrame | None = None) -> dict[str, DataFrame]:
    c = profile.cube(log, features) if cube is None else cube
    return {
        "ctr_by_day": profile.ctr_by_day(log), "ctr_by_hod": profile.ctr_by_hod(log), "topk_train": profile.top_k(c), "coverage_train": profile.coverage(c, vocab_k=vocab_k),
        "missing_train": profile.missing_rate(c), "min_k_train": profile.min_k(c, vocab_k), "oov_vs_train_vocab": profile.out_of_vocabulary(c, vocab_k),
    }


def drift_tables(log: DataFrame, features: list[str], pairs: list[tuple[str, str]] | None = None, k: int = 50, cube: DataFrame | None = None) -> dict[str, DataFrame]:
    c = profile.cube(log, features) if cube is None else cube
    cells = significance.pair_cells(log, c, pairs or DEFAULT_PAIRS, k)
    return {
        "psi_by_field_day": drift.psi_by_field_day(c, k), "psi_components_day": drift.psi_components(c, k), "new_value_rate_by_day": drift.novelty(c), "ctr_by_value_train": significance.ctr_by_value(c),
        "pair_interaction_combos": significance.pair_combos(cells), "pair_interaction_summary": significance.pair_summary(cells),
    }


def run_profile(spark: SparkSession, root: str, out: str, features: list[str]) -> list[str]:
    """Profile and drift tables of a materialized log.

    The cube is written first: the log is scanned once for it, once for the rates by time and
    once for the pairs, and every other table is made from the cube.
    """
    log = read_canonical(spark, root, features=features)
    c = profile.cube(log, features)
    c.write.mode("overwrite").parquet(f"{out}/value_cube")
    c = spark.read.schema(c.schema).parquet(f"{out}/value_cube")
    return write_tables(profile_tables(log, features, cube=c) | drift_tables(log, features, cube=c), out)


def replay(bids: DataFrame, order: list[str], budget: float, slots: int = 1, rule: str = "second_price") -> DataFrame:
    """Auctions, then budgets per bidder in auction order: what each bidder wins, pays and keeps."""
    won = auction.simulate(bids, order, slots, rule)
    spent = auction.spend_budgets(won.withColumn("cost", F.col("price")), budget, ["bidder_id"], ["auction_id", "slot"])
    return auction.budget_state(spent, budget, ["bidder_id"])


def replay_stream(spark: SparkSession, stream: str, out: str, budget: float, slots: int = 1, rule: str = "second_price") -> int:
    """Replay a recorded auction stream into a table of budgets by bidder; how many bidders won."""
    bids = read_auctions(spark, stream).select("auction_id", F.explode("bids").alias("b")).select("auction_id", "b.bidder_id", "b.bid_price")
    replay(bids, ["bidder_id"], budget, slots, rule).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()
