"""First passages over long horizons: when a series first reaches a level, by tables of ranges' extremes.

Rows of a symbol are dealt into buckets, each with the next rows of its symbol behind it (the halo). In a bucket, level k of a table holds the
greatest (or least) of each run of 2^k values. From its first row a search jumps by the longest run that doesn't reach its level, then by
shorter ones: a row looks at as many table cells as its horizon has binary digits, and copies no path. One table serves all
levels and parameter sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col


@dataclass(frozen=True)
class Passage:
    """name: the column for the place, from 0, of the first value of price that is at or beyond level (a column); up: from below."""

    name: str
    price: str
    level: str
    up: bool


def table_of(v: np.ndarray, horizon: int) -> list[np.ndarray]:
    """Level k holds the greatest of v[i : i + 2^k]; shorter runs at the end are not there."""
    out = [v]
    while 2 ** len(out) <= max(1, horizon) and len(out[-1]) > 2 ** (len(out) - 1):
        half = 2 ** (len(out) - 1)
        out.append(np.fmax(out[-1][:-half], out[-1][half:]))
    return out


def first_at(table: list[np.ndarray], start: np.ndarray, level: np.ndarray, horizon: int) -> np.ndarray:
    """For each row the place, counted from start, of the first value not below level among the next horizon ones; -1 if none.

    A level or a value that is not a number is never reached."""
    n = len(table[0])
    at, left = start.astype(np.int64).copy(), np.full(len(start), horizon, np.int64)
    live = ~np.isnan(level)
    for k in range(len(table) - 1, -1, -1):
        run, size = table[k], 2**k
        go = live & (left >= size) & (at + size <= n)
        go[go] = ~(run[at[go]] >= level[go])
        at[go] += size
        left[go] -= size
    hit = live & (left > 0) & (at < n)
    hit[hit] = table[0][at[hit]] >= level[hit]
    return np.where(hit, at - start, -1)


def first_passages(df: DataFrame, passages: list[Passage], horizon: int, delay: int = 0, key: str = "symbol", order: str = "ts", size: int = 50_000) -> DataFrame:
    """df with, for each passage, the place of its first hit among the horizon rows after the first delay following ones, null if
    none, and _ahead, how many of these rows there are.

    Rows are numbered by month and within it; null keys are a key. Equal times have no order of their own."""
    reach = delay + horizon
    size = max(size, reach)
    months = df.withColumn("_month", F.trunc(order, "month"))
    counts = months.groupBy(c(key).alias("_k"), c("_month").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_k", "_m", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(key, "_month").orderBy(order)) - 1
    rows = months.withColumn("_nth", nth).join(counts, c(key).eqNullSafe(c("_k")) & c("_month").eqNullSafe(c("_m")))
    rows = rows.withColumn("_row", (c("_before") + c("_nth")).cast("long")).select(*[c(f"`{x}`") for x in df.columns], "_row")
    steps = F.when((c("_row") % size < reach) & (c("_row") >= size), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("_back", F.explode(steps)).withColumn("_bucket", F.floor(c("_row") / size) - c("_back"))

    schema = T.StructType([*df.schema.fields, T.StructField("_ahead", T.LongType()), *[T.StructField(p.name, T.LongType()) for p in passages]])

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        own = np.flatnonzero(pdf["_back"].to_numpy() == 0)
        start = own + delay + 1
        out = pdf.iloc[own].reset_index(drop=True)
        out["_ahead"] = np.clip(len(pdf) - start, 0, horizon)
        tables: dict[tuple[str, bool], list[np.ndarray]] = {}
        for p in passages:
            sign = 1.0 if p.up else -1.0
            if (p.price, p.up) not in tables:
                tables[p.price, p.up] = table_of(sign * pdf[p.price].to_numpy(float, na_value=np.nan), horizon)
            place = first_at(tables[p.price, p.up], start, sign * pdf[p.level].to_numpy(float, na_value=np.nan)[own], horizon)
            out[p.name] = pd.Series(place, dtype="Int64").mask(place < 0)
        return out[schema.names]

    return dealt.groupBy(key, "_bucket").applyInPandas(bucket, schema)


def triple_barrier(df: DataFrame, horizon: int, delay: int = 1, profit: float = 1.2, stop: float = 0.8, atr: str = "atr_6", size: int = 50_000) -> DataFrame:
    """As labels.triple_barrier, for horizons of any length (L1)."""
    from tidemark.functions.frames import lead

    keep = df.columns
    df = df.withColumns({"_el": lead("ask_close", delay), "_es": lead("bid_close", delay), "_a": lead(atr, delay)})
    df = df.withColumns({"_l1": c("_el") + profit * c("_a"), "_l2": c("_el") - stop * c("_a"), "_l3": c("_es") - profit * c("_a"), "_l4": c("_es") + stop * c("_a")})
    wanted = [Passage("_lp", "bid_close", "_l1", True), Passage("_ls", "bid_close", "_l2", False), Passage("_sp", "ask_close", "_l3", False), Passage("_ss", "ask_close", "_l4", True)]
    df = first_passages(df, wanted, horizon, delay, size=size)
    whole = (c("_ahead") == horizon) & c("_a").isNotNull()

    def outcome(p, s):
        return F.when(~whole, None).when(p.isNotNull() & (s.isNull() | (p <= s)), 1).when(s.isNotNull(), -1).otherwise(0)

    won = {"long_outcome": outcome(c("_lp"), c("_ls")), "short_outcome": outcome(c("_sp"), c("_ss"))}
    times = {f"{side}_time": F.when(whole, F.coalesce(F.least(p, s), F.lit(horizon))).cast("int") for side, p, s in (("long", "_lp", "_ls"), ("short", "_sp", "_ss"))}
    df = df.withColumns(won | times)
    return df.withColumn("tb_label", (c("long_outcome") == 1).cast("int") - (c("short_outcome") == 1).cast("int")).select(*keep, *won, *times, "tb_label")


def barrier_grid(df: DataFrame, profits: list[float], stop: float, horizon: int, atr: str = "atr_6", size: int = 50_000) -> DataFrame:
    """profit, n, mean_r and win_rate of long trades at the close for each profit barrier, in units of atr (L8): one table a bucket serves all."""
    levels = {f"_u{i}": c("close") + p * c(atr) for i, p in enumerate(profits)} | {"_dn": c("close") - stop * c(atr)}
    wanted = [*[Passage(f"_hit{i}", "close", f"_u{i}", True) for i in range(len(profits))], Passage("_low", "close", "_dn", False)]
    found = first_passages(df.select("symbol", "ts", "close", atr).withColumns(levels), wanted, horizon, size=size).filter((c("_ahead") == horizon) & c(atr).isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profit"), c(f"_hit{i}").alias("u")) for i, p in enumerate(profits)])).alias("g")
    r = F.when(c("g.u").isNotNull() & (c("_low").isNull() | (c("g.u") <= c("_low"))), c("g.profit")).when(c("_low").isNotNull(), -stop).otherwise(0.0)
    return found.select(each, "_low").select(c("g.profit").alias("profit"), r.alias("r")).groupBy("profit").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"), F.avg((c("r") > 0).cast("int")).alias("win_rate"))
