"""First passages by tables of extremes and nearest events by as-of joins, against loops."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, labels, passage


def walk(n=3000, seed=2):
    rng = np.random.default_rng(seed)
    k = rng.choice(["hot", "b"], n, p=[0.95, 0.05])
    close = 100 + np.round(np.cumsum(rng.normal(0, 1, n)), 3)
    t = pd.DataFrame({"symbol": k, "ts": pd.Timestamp("2024-01-20") + pd.to_timedelta(np.arange(n) * 37, "min"), "close": close, "bid_close": close - 0.01, "ask_close": close + 0.01, "atr_6": 1.0 + rng.random(n)})
    t.loc[t.index % 50 == 0, "atr_6"] = np.nan
    return t


def frame(spark, t):
    df = spark.createDataFrame(t, "symbol string, ts timestamp_ntz, close double, bid_close double, ask_close double, atr_6 double")
    return df.withColumn("atr_6", F.when(~F.isnan("atr_6"), F.col("atr_6")))


@pytest.mark.parametrize("horizon", [1, 7, 64, 100])
def test_first_hit_among_the_next_values(horizon):
    rng = np.random.default_rng(horizon)
    v = np.round(rng.normal(0, 1, 700), 1)
    v[rng.integers(0, 700, 20)] = np.nan
    start, level = np.arange(700) + 1, np.round(rng.normal(1.5, 1, 700), 1)
    level[::31] = np.nan
    got = passage.first_at(passage.table_of(v, horizon), start, level, horizon)
    for i in range(700):
        ahead = v[start[i] : start[i] + horizon]
        hit = np.flatnonzero(ahead >= level[i])
        assert got[i] == (hit[0] if len(hit) else -1)


@pytest.mark.parametrize("size", [150, 50_000])
@pytest.mark.parametrize("horizon, profit", [(10, 1.2), (120, 6.0)])
def test_barriers_in_buckets_equal_copied_paths(spark, size, horizon, profit):
    df = frame(spark, walk())
    cols = ["symbol", "ts", "long_outcome", "short_outcome", "long_time", "short_time", "tb_label"]
    got = passage.triple_barrier(df, horizon, profit=profit, stop=profit * 0.8, size=size).select(*cols)
    want = labels.triple_barrier(df, horizon, profit=profit, stop=profit * 0.8).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_long_horizon_costs_little_more_than_a_short_one():
    v = np.random.default_rng(0).normal(0, 1, 300_000).cumsum()
    start = np.arange(300_000) + 1

    def took(horizon):
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            passage.first_at(passage.table_of(v, horizon), start, v + 3, horizon)
            best = min(best, time.process_time() - began)
        return best

    assert took(1440) < 6 * took(10)  # eleven levels against four, not 144 times


def test_nearest_events_with_dense_events_and_rows(spark):
    """All events and rows in one hour: as many rows come out as went in."""
    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1, 10)
    at = sorted(rng.integers(0, 3600, 500).tolist())
    ev = sorted(rng.choice(3600, 60, replace=False).tolist())
    rows = spark.createDataFrame([(i, start + dt.timedelta(seconds=s)) for i, s in enumerate(at)] + [(None, None), (0, start + dt.timedelta(seconds=at[0]))], "id int, ts timestamp_ntz")
    events = spark.createDataFrame([(start + dt.timedelta(seconds=s),) for s in ev + ev] + [(None,)], "ts timestamp_ntz")
    got = asof.in_event_windows(rows, events, 1, 2, seconds=900)
    assert got.count() == 502
    for r in got.filter("ts is not null").collect():
        s = at[r.id]
        assert (r.near_before, r.near_after) == (int(any(s < e <= s + 60 for e in ev)), int(any(s - 120 <= e <= s for e in ev)))
    near = {r.id: r.weight for r in asof.nearness(rows.filter("id is not null"), events, 30.0, 3.0).collect()}
    for i, s in enumerate(at):
        away = min(abs(s - e) for e in ev)
        assert abs(near[i] - (1 + 2 * (1 - away / 30) if away <= 30 else 1.0)) < 1e-9
