"""Feature encoders: fitted on train, applied as columns."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import number


def hash_bucket(c: Column, size: int = 10_000) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")), F.lit(size))


def bucket(c: Column, boundaries: list[float]) -> Column:
    """How many boundaries are not above the value; null stays null."""
    return sum((F.when(c >= b, 1).otherwise(0) for b in boundaries), F.when(c.isNotNull(), F.lit(0)))


def fit_vocabulary(train: DataFrame, col: str, size: int) -> DataFrame:
    """value, id: the most frequent values are numbered from 1, ties by value."""
    counts = train.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(size)
    return top.select("value", F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("id"))


def fit_moments(train: DataFrame, col: str) -> tuple[float, float]:
    r = train.agg(F.avg(number(F.col(col))).alias("m"), F.stddev_pop(number(F.col(col))).alias("s")).first()
    return r["m"] or 0.0, r["s"] or 0.0


@dataclass
class FeatureSpec:
    """One encoder.  Parameters may stand flat (hash_size, vocab_size, boundaries) or inside ``params``."""

    name: str
    transform: str = "none"
    params: dict = field(default_factory=dict)

    def get(self, key: str, *other: str, default=None):
        return next((self.params[k] for k in (key, *other) if k in self.params), default)


@dataclass
class FeatureMap:
    features: list[FeatureSpec] = field(default_factory=list)

    def get_feature(self, name: str) -> FeatureSpec | None:
        return next((f for f in self.features if f.name == name), None)

    def add_feature(self, spec: FeatureSpec) -> None:
        self.features.append(spec)

    def to_json(self) -> str:
        return json.dumps({"features": [asdict(f) for f in self.features]}, indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> FeatureMap:
        return cls([FeatureSpec(**f) for f in json.loads(text).get("features", [])])

    def fit(self, train: DataFrame) -> FittedFeatureMap:
        tables, moments = {}, {}
        for f in self.features:
            if f.transform == "vocab":
                tables[f.name] = fit_vocabulary(train, f.name, int(f.get("size", "vocab_size", default=10_000)))
            elif f.transform == "normalize":
                moments[f.name] = (f.get("mean"), f.get("std")) if f.get("std") is not None else fit_moments(train, f.name)
        return FittedFeatureMap(self, tables, moments)

    def fit_transform(self, train: DataFrame) -> DataFrame:
        return self.fit(train).transform(train)


@dataclass
class FittedFeatureMap:
    spec: FeatureMap
    tables: dict[str, DataFrame]
    moments: dict[str, tuple[float, float]]

    def save(self, folder: str) -> None:
        """What was fitted, as tables: the specification and moments in one row, and all vocabularies."""
        spark = SparkSession.active()
        state = [(self.spec.to_json(), json.dumps(self.moments))]
        spark.createDataFrame(state, "spec string, moments string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state")
        empty = spark.createDataFrame([], "feature string, value string, id int")
        named = [t.select(F.lit(n).alias("feature"), F.col("value").cast("string"), F.col("id").cast("int")) for n, t in self.tables.items()]
        reduce(DataFrame.unionByName, named, empty).write.mode("overwrite").partitionBy("feature").parquet(f"{folder}/vocabularies")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> FittedFeatureMap:
        """Vocabularies come back with their values as strings."""
        state = spark.read.parquet(f"{folder}/state").first()
        spec = FeatureMap.from_json(state["spec"])
        rows = spark.read.schema("value string, id int, feature string").parquet(f"{folder}/vocabularies")
        return cls(spec, {f.name: rows.where(F.col("feature") == f.name).select("value", "id") for f in spec.features if f.transform == "vocab"}, {k: tuple(v) for k, v in json.loads(state["moments"]).items()})

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each feature by its encoding.  Vocabularies have a stated size; Spark broadcasts the small ones."""
        for f in self.spec.features:
            c = F.col(f.name)
            if f.transform == "hash":
                df = df.withColumn(f.name, hash_bucket(c, int(f.get("size", "hash_size", default=10_000))))
            elif f.transform == "bucket":
                df = df.withColumn(f.name, bucket(number(c), list(f.get("boundaries", default=[]))))
            elif f.transform == "normalize":
                mean, std = self.moments[f.name]
                df = df.withColumn(f.name, (number(c) - mean) / std if std else F.lit(0.0))
            elif f.transform == "log":
                df = df.withColumn(f.name, F.log1p(F.greatest(number(c), F.lit(0.0))))
            elif f.transform == "sequence":
                df = df.withColumn(f.name, last_items(F.split(c, f.get("sep", default=",")), int(f.get("max_len", default=100))))
            elif f.transform == "vocab":
                v = self.tables[f.name].select(F.col("value").alias(f.name), F.col("id").alias("_id_of"))
                df = df.join(v, f.name, "left").withColumn(f.name, F.coalesce("_id_of", F.lit(0))).drop("_id_of")
            elif f.transform != "none":
                raise ValueError(f"unknown transform {f.transform!r}")
        return df


def last_items(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), F.lit(n))


def build_sequences(df: DataFrame, user: str, time: str, item: str, tie: str | None = None, max_len: int = 100) -> DataFrame:
    """user, sequence: each user's last ``max_len`` items in time order; older ones go before they are gathered."""
    keys = [time, *([tie] if tie else []), item]
    newest = Window.partitionBy(user).orderBy(*[F.desc(k) for k in keys])
    last = df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= max_len)
    return last.groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct(*keys))), lambda s: s[item]).alias("sequence"))


def cross_day(daily: DataFrame, key: str, day_number: str, measures: list[str], windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Sums of each measure over the 1, 7 and 30 days before a day: d1_, d7_, d30_."""
    over = {n: Window.partitionBy(key).orderBy(day_number).rangeBetween(-n, -1) for n in windows}
    return daily.withColumns({f"d{n}_{m}": F.coalesce(F.sum(m).over(w), F.lit(0)) for n, w in over.items() for m in measures})


def calendar(ts: Column) -> dict[str, Column]:
    return {"day_of_week": F.dayofweek(ts), "hour_of_day": F.hour(ts)}
