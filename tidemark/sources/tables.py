"""Ticks and other market tables from generic event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, id, mid, volume, spread, bid, ask from events; prices are the events' values."""
    spread = F.lit(0.01) * (1 + F.col("event_id") % 5)
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("id"),
        F.col("value").alias("mid"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        spread.alias("spread"),
        (F.col("value") - spread / 2).alias("bid"),
        (F.col("value") + spread / 2).alias("ask"),
    )
