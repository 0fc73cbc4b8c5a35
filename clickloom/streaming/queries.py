"""Structured Streaming: windowed rates, first-seen values, running counts, budgets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir


def read_stream(spark: SparkSession, path: str, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """A stream of the parquet files that come into a folder."""
    fields = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(fields).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path)


def ctr_windows(events: DataFrame, ts: str = "ts", late: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Click rate by event-time window, with late rows accepted for ``late``."""
    t = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    click = (F.col("event_type") == "click").cast("long")
    return t.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("impressions"), F.sum(click).alias("clicks")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "impressions", "clicks")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    t = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(user, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def first_seen(long: DataFrame) -> DataFrame:
    """Each (feature, value) once, when it first comes."""
    return long.dropDuplicates(["feature", "value"])


def running_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))


def spend_stream(events: DataFrame, limit: float, by: str = "budget_id", cost: str = "cost", order: str = "seq") -> DataFrame:
    """Greedy budgets over a stream: one number of state per budget; rows of a micro-batch in ``order``."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        pdf = pd.concat(list(pdfs)).sort_values(order)
        ok = []
        for c in pdf[cost]:
            fits = spent + c <= limit
            spent += c if fits else 0.0
            ok.append(fits)
        state.update((spent,))
        yield pd.DataFrame({by: key[0], order: pdf[order], cost: pdf[cost], "accepted": ok})

    out = f"{by} long, {order} long, {cost} double, accepted boolean"
    return events.groupBy(by).applyInPandasWithState(fold, out, "spent double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over what is there and return the result (for tests and small jobs)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over what is there into a table of the shared folder, and read it.

    In mode complete every micro-batch replaces the table.  Rows never pass through the driver.
    """
    path = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-progress")
    if mode == "complete":
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        w = w.format("parquet").option("path", path)
    w.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
