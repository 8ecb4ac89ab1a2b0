"""Bars from ticks, by time and by activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ohlc() -> list[Column]:
    """Open to close by time and id, so that ties have one order; combined on the map side."""
    at = F.struct("ts", "id")
    return [
        F.min_by("mid", at).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", at).alias("close"),
        F.sum("volume").alias("volume"),
        F.avg("spread").alias("spread"),
        F.max_by("bid", at).alias("bid_close"),
        F.max_by("ask", at).alias("ask_close"),
        F.count(F.lit(1)).alias("n"),
    ]


def time_bars(ticks: DataFrame, every: str = "6 hours") -> DataFrame:
    """Bars closed on the left, named by their start."""
    return ticks.groupBy("symbol", F.window("ts", every).alias("w")).agg(*ohlc()).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "spread", "bid_close", "ask_close", "n")


def placed(ticks: DataFrame, amount: Column) -> DataFrame:
    """total: the sum of amount over a symbol's ticks before and with each one.

    In two passes, so that one symbol spreads over many tasks: sums by day, then within the day."""
    days = ticks.withColumn("_day", F.to_date("ts")).withColumn("_amount", amount.cast("double"))
    order = Window.partitionBy("symbol", "_day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    sums = days.groupBy("symbol", "_day").agg(F.sum("_amount").alias("_sum"))
    sums = sums.select("symbol", "_day", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    return (
        days.withColumn("_in_day", F.sum("_amount").over(order))
        .join(sums, ["symbol", "_day"])
        .withColumn("total", F.col("_in_day") + F.col("_before"))
        .drop("_day", "_in_day", "_before")
    )


def activity_bars(ticks: DataFrame, amount: Column, size: float, whole_only: bool = False) -> DataFrame:
    """Bars of so much amount each: ticks (amount 1), volume, or volume times price; a tick belongs where its amount begins."""
    at = placed(ticks, amount).withColumn("bar", F.floor((F.col("total") - F.col("_amount") + 1e-9) / size).cast("long"))
    bars = at.groupBy("symbol", "bar").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("_amount").alias("amount"), *ohlc())
    return bars.filter(F.col("amount") >= size - 1e-9) if whole_only else bars


def in_buckets(bars: DataFrame, back: int, size: int = 100_000, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Splits long symbols for windows of up to back earlier rows: columns bucket and halo.

    Windows by (symbol, bucket) give on rows without halo what windows by symbol give. A row's number comes from the
    days' counts and its place in the day; the last rows of a bucket stand in the next one too, as halo. A null symbol or time is one too."""
    days = bars.withColumn("_day", F.to_date("ts"))
    in_day = Window.partitionBy("symbol", "_day").orderBy(*order)
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    counts = days.groupBy("symbol", "_day").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.col("symbol").alias("_of"), F.col("_day").alias("_on"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = F.col("symbol").eqNullSafe(F.col("_of")) & F.col("_day").eqNullSafe(F.col("_on"))
    row = F.row_number().over(in_day) - 1 + F.col("_before")
    placed_rows = days.join(counts, met).withColumn("_row", row).withColumn("_bucket", F.floor(F.col("_row") / size))
    copies = F.when(F.col("_row") % size >= size - back, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = placed_rows.withColumn("_step", F.explode(copies))
    return spread.withColumn("bucket", F.col("_bucket") + F.col("_step")).withColumn("halo", F.col("_step") == 1).drop("_day", "_of", "_on", "_before", "_row", "_bucket", "_step")
