"""Sources: raw click logs, canonical logs, auction streams, delimited files."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field
from importlib import import_module

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import scalar as X


class Registry:
    """Named things; registering a name twice or asking for an unknown one is an error."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str):
        def add(item):
            if name in self._items:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._items[name] = item
            return item

        return add

    def get(self, name: str):
        if name not in self._items:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self._items)}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)

    def __contains__(self, name: str) -> bool:
        return name in self._items


SOURCES = Registry("source")


@dataclass
class SplitSpec:
    """How rows are assigned to train, valid and test."""

    method: str = "time"
    day_col: str = "_day"
    id_col: str = "_id"
    train_end_day: int | None = None
    train_days: list[int] | None = None
    valid_day: int | None = None
    valid_days: list[int] | None = None
    test_day: int | None = None
    test_days: list[int] | None = None
    train_ratio: float = 0.8
    valid_ratio: float = 0.1
    test_ratio: float = 0.1
    hash_key: str = "split_v1"
    assert_disjoint: bool = True

    def masks(self) -> dict[str, Column]:
        """A condition per split."""
        if self.method == "none":
            return {"train": F.lit(True), "valid": F.lit(False), "test": F.lit(False)}
        if self.method in ("time", "day"):
            day = F.col(self.day_col)
            if self.train_days:
                train = day.isin(list(self.train_days))
            elif self.train_end_day is not None:
                train = day <= self.train_end_day
            else:
                raise ValueError("a time split needs train_days or train_end_day")
            pick = lambda days, one: day.isin(list(days)) if days else day == one if one is not None else F.lit(False)
            self._check_days()
            return {"train": train, "valid": pick(self.valid_days, self.valid_day), "test": pick(self.test_days, self.test_day)}
        if self.method == "random":
            if abs(self.train_ratio + self.valid_ratio + self.test_ratio - 1) > 1e-8:
                raise ValueError("split ratios must add up to 1")
            u = X.unit_hash(self.hash_key, F.col(self.id_col))
            a, b = self.train_ratio, self.train_ratio + self.valid_ratio
            return {"train": u < a, "valid": (u >= a) & (u < b), "test": u >= b}
        raise ValueError(f"unknown split method {self.method!r}")

    def _check_days(self) -> None:
        if not self.assert_disjoint:
            return
        valid = set(self.valid_days or ([self.valid_day] if self.valid_day is not None else []))
        test = set(self.test_days or ([self.test_day] if self.test_day is not None else []))
        train = lambda d: d in self.train_days if self.train_days else d <= self.train_end_day
        both = {"train/valid": sum(map(train, valid)), "train/test": sum(map(train, test)), "valid/test": len(valid & test)}
        if any(both.values()):
            raise ValueError(f"splits overlap: {both}")

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``split``; rows of no split are dropped."""
        m = self.masks()
        return df.withColumn("split", F.when(m["train"], "train").when(m["valid"], "valid").when(m["test"], "test")).where("split is not null")


def find_parquet(path: str, default_name: str) -> str:
    """The path itself, or a named file inside it if that is there; remote paths are left to Spark."""
    inner = os.path.join(path, default_name)
    if "://" not in path and os.path.isdir(path) and os.path.exists(inner):
        return inner
    return path


def with_row_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Number rows without gaps, by partition and place.

    Places inside partitions come from the scan; the partitions' row counts, one row for each,
    are summed and broadcast, so rows stay where they are.
    """
    if name in df.columns:
        return df
    placed = df.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("row"), F.monotonically_increasing_id().alias("place"))
    part = F.shiftright("place", 33)
    counts = df.select(F.monotonically_increasing_id().alias("place")).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ident = (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    return placed.join(F.broadcast(before), part == F.col("part")).select(*(F.col("row").getField(c).alias(c) for c in df.columns), ident)


@SOURCES.register("click_log")
@dataclass
class ClickLogSource:
    """A raw parquet click log brought into the canonical form."""

    train_path: str = ""
    test_path: str | None = None
    split: SplitSpec = field(default_factory=SplitSpec)
    features: list[str] = field(default_factory=lambda: list(S.FEATURES))
    strict: bool = False
    time_col: str = "hour"

    def scan(self, spark: SparkSession, path: str) -> DataFrame:
        try:
            df = spark.read.parquet(find_parquet(path, "train.parquet"))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise FileNotFoundError(f"no parquet log at {path!r}") from e
            raise
        wanted = {"id", "click", self.time_col, *self.features, *S.ALIASES}
        if self.strict and (gone := [c for c in [self.time_col, *self.features] if c not in df.columns and c not in S.ALIASES.values()]):
            raise ValueError(f"columns are missing: {gone}")
        return df.select(*[c for c in df.columns if c in wanted])

    def canonicalize(self, df: DataFrame, external_test: bool = False) -> DataFrame:
        """One projection: id, label, day and hour, then the features as strings with a token for what is missing."""
        for raw, name in S.ALIASES.items():
            if raw in df.columns and name not in df.columns:
                df = df.withColumnRenamed(raw, name)
        if "click" not in df.columns and not external_test:
            raise ValueError("the log has no column click")
        if self.time_col not in df.columns:
            raise ValueError(f"the log has no column {self.time_col}")
        df = with_row_id(df)
        label = F.col("click").cast("tinyint") if "click" in df.columns else F.lit(None).cast("tinyint")
        feature = lambda f: X.filled(F.col(f)) if f in df.columns else F.lit(S.MISSING)
        hour = F.col(self.time_col)
        return df.select(F.col("id").cast("string").alias("_id"), X.hour_day(hour).alias("_day"), X.hour_of_day(hour).alias("_hod"), label.alias("_label_click"), *(feature(f).alias(f) for f in self.features))

    def _checked(self, log: DataFrame) -> DataFrame:
        """A log whose hours can't be read at all is an error; the first row that can be read ends the look."""
        if log.where("_day is not null").isEmpty() and not log.isEmpty():
            raise ValueError(f"column {self.time_col} holds no hour")
        return log

    def load(self, spark: SparkSession) -> DataFrame:
        """The canonical log with its split; rows of an external test file count as test in addition."""
        out = self.split.assign(self._checked(self.canonicalize(self.scan(spark, self.train_path))))
        if self.test_path:
            out = out.unionByName(self._checked(self.canonicalize(self.scan(spark, self.test_path), external_test=True)).withColumn("split", F.lit("test")))
        return out

    def config(self) -> dict:
        """The configuration that ``build_source`` makes this source from."""
        params = {k: v for k, v in asdict(self).items() if k != "split"}
        return {"source": "click_log", "params": params, "split": asdict(self.split)}


@SOURCES.register("delimited")
@dataclass
class DelimitedSource:
    """A text file with separators, for the log families that come as csv or tsv."""

    path: str
    columns: str  # a DDL schema
    sep: str = ","
    header: bool = True
    labels: tuple[str, ...] = ("click",)
    time_col: str = "time"

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.read.csv(self.path, schema=self.columns, sep=self.sep, header=self.header)

    def get_features(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(",") if c.split()[0] not in (*self.labels, self.time_col)]


# The features and labels of the declared log families.
FAMILIES = {
    "multitask_ecommerce": ("user_id string, item_id string, category_id string, merchant_id string, brand_id string, price double, time long, clk int, cvr int", ("clk", "cvr")),
    "closed_loop_rtb": ("impression_id string, weekday string, hour string, ip_id string, region string, city string, user_agent string, os string, browser string, advertiser string, user_profile_id_1 string, user_profile_id_2 string, user_profile_id_3 string, user_profile_id_4 string, user_profile_id_5 string, user_profile_id_6 string, time long, click int", ("click",)),
}


def build_source(config: dict):
    """A source from a configuration: a registered name or a dotted class path, and its arguments."""
    args = dict(config.get("params", {}))
    if "split" in config:
        args["split"] = SplitSpec(**config["split"])
    kind = config.get("class_path") or config["source"]
    if "." in kind:
        module, _, name = kind.rpartition(".")
        return getattr(import_module(module), name)(**args)
    return SOURCES.get(kind)(**args)


def read_canonical(spark: SparkSession, root: str, split: str | None = None, features: list[str] = S.FEATURES) -> DataFrame:
    """The materialized log; a split is read by pruning partitions."""
    fields = S.canonical(features).add("split", T.StringType()).add("day", T.IntegerType())
    df = spark.read.schema(fields).parquet(root)
    return df.where(F.col("split") == split) if split else df


def read_auctions(spark: SparkSession, path: str) -> DataFrame:
    """An auction stream, one JSON object a line; blank lines are skipped."""
    df = spark.read.schema(S.AUCTION).json(path).where("auction_id is not null")
    return df.withColumns({"num_slots": F.coalesce("num_slots", F.lit(1)), "auction_type": F.coalesce("auction_type", F.lit("second_price"))})


def stream_auctions(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Replay a recorded stream as a stream, some files at a time."""
    return spark.readStream.schema(S.AUCTION).option("maxFilesPerTrigger", files).json(folder).where("auction_id is not null")


def write_auctions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_auctions(df: DataFrame, path: str) -> None:
    """Add auctions to a recorded stream."""
    df.write.mode("append").json(path)


def auction_at(auctions: DataFrame, index: int) -> dict | None:
    """The auction at a place of the stream in the order of (timestamp, auction_id); from the end where negative, None past it."""
    order = [F.desc("timestamp"), F.desc("auction_id")] if index < 0 else ["timestamp", "auction_id"]
    first = auctions.orderBy(*order).offset(-index - 1 if index < 0 else index).limit(1).collect()
    return first[0].asDict(recursive=True) if first else None


def mini_batches(df: DataFrame, size: int = 32, shuffle: bool = False, seed: int = 42):
    """Batches of rows for a trainer, streamed partition by partition; ``shuffle`` mixes the rows of each partition."""
    rows, batch = (df.sortWithinPartitions(F.rand(seed)) if shuffle else df).toLocalIterator(prefetchPartitions=True), []
    for r in rows:
        batch.append(r.asDict())
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def canon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a canonical log with features user_id, k, value_bin, hour_str, and its split."""
    return event_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_log(e: DataFrame) -> DataFrame:
    """Rows of the event table, batch or stream, in canonical form."""
    k = F.get_json_object("props", "$.k")
    log = e.select(
        F.col("event_id").cast("string").alias("_id"),
        F.date_format("ts", "yyyyMMdd").cast("int").alias("_day"),
        F.hour("ts").cast("smallint").alias("_hod"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).cast("tinyint").alias("_label_click"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(k == "0", S.MISSING).otherwise(k).alias("k"),
        F.floor(F.col("value") / 10).cast("int").cast("string").alias("value_bin"),
        F.hour("ts").cast("string").alias("hour_str"),
    )
    return EVENT_SPLIT.assign(log)


EVENT_FEATURES = ["user_id", "k", "value_bin", "hour_str"]
EVENT_SPLIT = SplitSpec(train_end_day=20240124, valid_days=[20240125, 20240126, 20240127], test_days=[20240128, 20240129, 20240130])
