"""Node endpoints: which to trust, and how often they are asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def healthy(endpoints: DataFrame, max_behind: int = 5) -> DataFrame:
    """Endpoints at most ``max_behind`` blocks behind the highest, with ``tip``: the height
    that all of them have. One row each; an endpoint without a height is not healthy."""
    best = endpoints.agg(F.max("height").alias("best"))
    near = endpoints.join(F.broadcast(best), F.col("height") >= F.col("best") - max_behind)  # one row
    tip = near.agg(F.min("height").alias("tip"))
    return near.join(F.broadcast(tip), F.lit(True)).select("endpoint", "height", "tip")


def request_rates(requests: DataFrame, seconds: int = 1) -> DataFrame:
    """Requests of each tumbling window, by endpoint and in total (endpoint null)."""
    window = F.window("ts", f"{seconds} seconds")
    counts = requests.groupBy(window.alias("w"), "endpoint").agg(F.count("*").alias("n"))
    total = counts.groupBy("w").agg(F.sum("n").alias("n")).select("w", F.lit(None).cast("string").alias("endpoint"), "n")
    return counts.unionByName(total).select(F.col("w.start").alias("second"), "endpoint", "n")


def throughput(batches: DataFrame) -> DataFrame:
    """Blocks per second of ingest batches ``n_blocks, millis``."""
    return batches.select("*", (F.col("n_blocks") * 1000 / F.when(F.col("millis") > 0, F.col("millis"))).alias("blocks_per_second"))
