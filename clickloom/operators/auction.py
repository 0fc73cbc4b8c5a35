"""Auction replay: bids, prices, budgets, key figures."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bid_price(strategy: str | Callable[..., Column], pctr: Column, pcvr: Column | None = None, value: Column | None = None, base_cpc: float = 1.0, multiplier: float = 1.0, target_cpa: float = 1.0, target_roi: float = 1.0) -> Column:
    """A bid by a named strategy (ecpm, cpa, roi) or by a function of (pctr, pcvr, value)."""
    if callable(strategy):
        return strategy(pctr, pcvr, value)
    if strategy == "ecpm":
        return pctr * base_cpc * multiplier * 1000
    if strategy == "cpa":
        return pctr * pcvr * target_cpa
    if strategy == "roi":
        return pctr * pcvr * value / target_roi
    raise ValueError(f"unknown bid strategy {strategy!r}")


def simulate(bids: DataFrame, order: list[str], slots: int = 1, rule: str = "second_price", reserve: float = 0.0, fee: float = 0.0) -> DataFrame:
    """Winners of every auction: auction_id, slot, the bid's columns, price, platform_fee.

    Bids are ranked by price, ties by ``order``.  first_price: a winner pays its bid;
    second_price: the next bid; vcg (slots of equal worth): the best losing bid.  Where no such bid
    is, the reserve is paid.
    """
    ranks = Window.partitionBy("auction_id").orderBy(F.desc("bid_price"), *order)
    r = bids.where(F.col("bid_price") >= reserve).withColumn("slot", F.row_number().over(ranks))
    if rule == "first_price":
        price = F.col("bid_price")
    elif rule == "second_price":
        price = F.coalesce(F.lead("bid_price").over(ranks), F.lit(reserve))
    elif rule == "vcg":
        price = F.coalesce(F.max(F.when(F.col("slot") == slots + 1, F.col("bid_price"))).over(Window.partitionBy("auction_id")), F.lit(reserve))
    else:
        raise ValueError(f"unknown auction rule {rule!r}")
    return r.withColumn("price", price).where(F.col("slot") <= slots).withColumn("platform_fee", F.col("price") * fee)


def spend_budgets(events: DataFrame, limit: float, by: list[str], order: list[str], cost: str = "cost") -> DataFrame:
    """Ordered greedy spending: each event of a budget is paid if it still fits, else passed over.

    Returns the events with ``accepted`` and ``spent_after``.  The fold runs over a budget's
    events in order and keeps one number, so batches of a group stream through.
    """
    used = events.select(*by, *[c for c in order if c not in by], cost)
    fields = T.StructType([*used.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("spent_after", T.DoubleType())])
    sorted_ = used.repartition(*by).sortWithinPartitions(*by, *order)

    def fold(batches):
        key, spent = None, 0.0
        for pdf in batches:
            ok, after = [], []
            for k, c in zip(zip(*(pdf[b] for b in by)), pdf[cost]):
                if k != key:
                    key, spent = k, 0.0
                fits = spent + c <= limit
                spent += c if fits else 0.0
                ok.append(fits)
                after.append(spent)
            yield pdf.assign(accepted=pd.Series(ok, dtype=bool, index=pdf.index), spent_after=pd.Series(after, dtype=float, index=pdf.index))

    return sorted_.mapInPandas(fold, fields)


def budget_state(spent: DataFrame, limit: float, by: list[str], cost: str = "cost") -> DataFrame:
    """by, spent, remaining, utilization (0 for a budget of nothing), accepted, events."""
    g = spent.groupBy(*by).agg(F.sum(F.when(F.col("accepted"), F.col(cost)).otherwise(0.0)).alias("spent"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.lit(1)).alias("events"))
    return g.withColumns({"remaining": F.lit(limit) - F.col("spent"), "utilization": F.col("spent") / limit if limit > 0 else F.lit(0.0)})


def kpis(events: DataFrame, by: list[str] | None = None, impressions_mode: str = "impression", budget: float | None = None) -> DataFrame:
    """Key figures of (winner, impression, click, conversion, spend, value) events.

    Impressions count once; in mode ``legacy`` a winner counts one more.  Ratios are null
    where their denominator is 0.
    """
    one = lambda c: F.sum(F.col(c).cast("long"))
    won = lambda c: F.sum(F.when(F.col("winner"), F.col(c)).otherwise(0.0))
    imps = one("impression") + one("winner") if impressions_mode == "legacy" else one("impression")
    revenue = F.sum(F.when(F.col("conversion"), F.col("value")).otherwise(0.0))
    g = events.groupBy(*(by or [])).agg(won("spend").alias("spend"), imps.alias("impressions"), one("click").alias("clicks"), one("conversion").alias("conversions"), revenue.alias("revenue"))
    out = g.withColumns({
        "ctr": F.try_divide("clicks", "impressions"), "cvr": F.try_divide("conversions", "impressions"), "cpc": F.try_divide("spend", "clicks"), "cpa": F.try_divide("spend", "conversions"),
        "rpm": F.try_divide(1000 * F.col("spend"), F.col("impressions")),
    })
    return out.withColumn("budget_utilization", F.col("spend") / budget) if budget else out


def stream_totals(auctions: DataFrame) -> DataFrame:
    """Totals of an auction stream: auctions, bids, impressions, clicks, conversions, first and last timestamp."""
    count = lambda f: F.sum(F.size(F.filter(F.coalesce("bids", F.array()), lambda b: b[f])))
    return auctions.agg(F.count(F.lit(1)).alias("total_auctions"), F.sum(F.size(F.coalesce("bids", F.array()))).alias("total_bids"), count("impression").alias("total_impressions"), count("click").alias("total_clicks"), count("conversion").alias("total_conversions"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))


def build_auctions(bids: DataFrame, auction_cols: list[str]) -> DataFrame:
    """Nest bid rows under their auction (an auction's bids are few)."""
    rest = [c for c in bids.columns if c not in auction_cols]
    return bids.groupBy(*auction_cols).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("bids"))
