"""Order statistics of long sliding frames: a frame is kept in order as it moves, not sorted anew for each row.

Functions.frames.Roll.quantile sorts each row's frame, which suits short ones. Here a symbol's rows are dealt into buckets with the rows
that their first frames reach back to, and in a bucket a value enters and leaves an ordered list in logarithmic time, so a frame of
1,440 rows costs little more than one of 60.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bars import in_buckets


@dataclass(frozen=True)
class Rank:
    """The q-quantile, linear between ranks, of the last n values of a column, up to skip rows before each row; null below least
    values (by default n)."""

    column: str
    n: int
    q: float
    least: int | None = None
    skip: int = 0


def rank(x: np.ndarray, null: np.ndarray, r: Rank) -> np.ndarray:
    """The rank of each row's frame. pandas leaves out what isn't finite; where there is such a value, places among all values are ranked."""
    def rolling(v: np.ndarray):
        return pd.Series(np.where(null, np.nan, v)).shift(r.skip).rolling(r.n, min_periods=r.n if r.least is None else r.least)

    if np.isfinite(x[~null]).all():
        return rolling(x).quantile(r.q).to_numpy()
    values, places = np.unique(x, return_inverse=True)  # an undefined value comes last
    frames = rolling(places.astype(float))
    low, high = (frames.quantile(r.q, interpolation=how).to_numpy() for how in ("lower", "higher"))
    at = r.q * (frames.count().to_numpy() - 1)
    out, known = np.full(len(x), np.nan), ~np.isnan(low)
    a, b = values[low[known].astype(int)], values[high[known].astype(int)]
    share = (at - np.floor(at))[known]
    with np.errstate(invalid="ignore"):
        out[known] = np.where(a == b, a, a * (1 - share) + b * share)
    return out


def rolling_ranks(df: DataFrame, wanted: dict[str, Rank], size: int = 100_000, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """df (symbol, ts and more) with a column for each rank. Nulls are in no frame's count; a null symbol is a symbol.

    Infinite values count, and so do undefined ones, as the largest."""
    back = max(r.n + r.skip for r in wanted.values())
    nobody = df.withColumn("_missing", F.col("symbol").isNull()).withColumn("symbol", F.coalesce("symbol", F.lit("")))
    nobody = nobody.withColumns({f"_null_{n}": F.col(r.column).isNull() for n, r in wanted.items()})
    dealt = in_buckets(nobody, back, max(size, back), order)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in wanted]])

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        # halo rows come first: they are the last rows of the bucket before
        pdf = pdf.sort_values(["halo", *order], ascending=[False, *[True] * len(order)], ignore_index=True)
        for name, r in wanted.items():
            x = pdf[r.column].to_numpy(float, na_value=np.nan)
            pdf[name] = rank(x, pdf[f"_null_{name}"].to_numpy(bool), r)
        own = pdf[~pdf["halo"]].copy()
        own.loc[own["_missing"], "symbol"] = None
        return own[schema.names]

    return dealt.groupBy("symbol", "_missing", "bucket").applyInPandas(bucket, schema)


def value_at_risk(df: DataFrame, r: str, n: int = 1440, least: int = 60) -> DataFrame:
    """var_95 and var_99, the losses that returns before each row exceeded in 5 and 1 of 100, and whether its own return breaks them."""
    out = rolling_ranks(df, {"var_95": Rank(r, n, 0.05, least, 1), "var_99": Rank(r, n, 0.01, least, 1)})
    return out.withColumns({f"breach_{k}": F.coalesce((F.col(r) < F.col(f"var_{k}")).cast("int"), F.lit(0)) for k in (95, 99)})


def vacuum(df: DataFrame, spread: str = "spread", n: int = 120, eps: float = 1e-9) -> DataFrame:
    """liquidity_vacuum: the spread over its median of the last n rows."""
    return rolling_ranks(df, {"_middle": Rank(spread, n, 0.5)}).withColumn("liquidity_vacuum", F.col(spread) / (F.col("_middle") + eps)).drop("_middle")
