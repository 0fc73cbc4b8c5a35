"""The canonical click log: fixed names, types and tokens."""

from __future__ import annotations

from pyspark.sql import types as T

MISSING, OTHER, NULL_ID = "__MISSING__", "__OTHER__", "__NULL__"

# The features of the canonical log, and the other raw names some of them go by.
FEATURES = [
    "C1", "C14", "C15", "C16", "C17", "C18", "C19", "C20", "C21", "banner_pos", "site_id", "site_domain", "site_category",
    "app_id", "app_domain", "app_category", "device_id", "device_ip", "device_model", "device_type", "device_conn_type",
]
ALIASES = {
    "C2": "banner_pos", "C3": "site_id", "C4": "site_domain", "C5": "site_category", "C6": "app_id", "C7": "app_domain",
    "C8": "app_category", "C9": "device_id", "C10": "device_ip", "C11": "device_model", "C12": "device_type", "C13": "device_conn_type",
}
KEYS = ["_id", "_day", "_hod", "_label_click"]


def canonical(features: list[str] = FEATURES) -> T.StructType:
    return T.StructType([T.StructField("_id", T.StringType()), T.StructField("_day", T.IntegerType()), T.StructField("_hod", T.ShortType()), T.StructField("_label_click", T.ByteType()), *(T.StructField(f, T.StringType()) for f in features)])


BID = T.StructType([
    T.StructField("auction_id", T.StringType()), T.StructField("bidder_id", T.StringType()), T.StructField("bid_price", T.DoubleType()), T.StructField("advertiser_id", T.StringType()),
    T.StructField("winning", T.BooleanType()), T.StructField("impression", T.BooleanType()), T.StructField("click", T.BooleanType()), T.StructField("conversion", T.BooleanType()),
    T.StructField("market_price", T.DoubleType()), T.StructField("features", T.MapType(T.StringType(), T.StringType())), T.StructField("predicted_ctr", T.DoubleType()), T.StructField("predicted_cvr", T.DoubleType()),
])
AUCTION = T.StructType([
    T.StructField("auction_id", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("num_slots", T.IntegerType()), T.StructField("auction_type", T.StringType()), T.StructField("bids", T.ArrayType(BID)),
    T.StructField("winning_bid_id", T.StringType()), T.StructField("clearing_price", T.DoubleType()), T.StructField("user_features", T.MapType(T.StringType(), T.StringType())), T.StructField("context_features", T.MapType(T.StringType(), T.StringType())),
])
