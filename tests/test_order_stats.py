"""Quantiles of long sliding frames in buckets, against frames that are sorted row by row."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.frames import Roll
from tidemark.operators import order_stats
from tidemark.operators.order_stats import Rank


def series(n=1500, seed=4):
    rng = np.random.default_rng(seed)
    t = pd.DataFrame({"symbol": rng.choice(["hot", "b"], n, p=[0.93, 0.07]), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 11, "min"), "x": rng.normal(0, 1, n).round(2)})
    t.loc[rng.integers(0, n, 60), "x"] = np.nan
    return t


def frame(spark, t):
    return spark.createDataFrame(t, "symbol string, ts timestamp_ntz, x double").withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@pytest.mark.parametrize("size", [130, 100_000])
def test_ranks_equal_sorted_frames(spark, size):
    df = frame(spark, series())
    wanted = {"a": Rank("x", 60, 0.5), "b": Rank("x", 120, 0.05, 20), "c": Rank("x", 31, 0.9, 5, 1)}
    got = order_stats.rolling_ranks(df, wanted, size).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    roll = lambda r: Roll(r.n, r.least, r.skip).quantile(F.col("x"), r.q)
    want = df.withColumns({n: roll(r) for n, r in wanted.items()}).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == 1500
    for n in wanted:
        assert np.allclose(got[n].to_numpy(float), want[n].to_numpy(float), equal_nan=True)


def test_null_symbols_and_empty_tables(spark):
    t = series(200)
    t["symbol"] = None
    got = order_stats.rolling_ranks(frame(spark, t), {"m": Rank("x", 9, 0.5, 1)})
    assert got.filter("symbol is null").count() == 200
    assert order_stats.rolling_ranks(frame(spark, series()).limit(0), {"m": Rank("x", 9, 0.5)}).count() == 0


def test_a_frame_of_a_day_costs_little_more_than_one_of_an_hour():
    x = pd.Series(np.random.default_rng(0).normal(0, 1, 200_000))

    def took(n):
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            x.rolling(n, min_periods=n).quantile(0.5)
            best = min(best, time.process_time() - began)
        return best

    assert took(1440) < 4 * took(60)
