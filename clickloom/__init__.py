"""Click-log analytics on Spark: canonical logs, profiles, drift, significance, sketches, auctions, metrics."""
