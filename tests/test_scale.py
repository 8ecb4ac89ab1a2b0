"""Operators that deal series out by time or value give what one task a key would give."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, bars, clean, stats


def skewed(n=3000, seed=1):
    """One symbol holds 95 % of the rows; a few nulls among keys and values."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 5 * 86_400, n))
    k = rng.choice(["hot", "b", "c"], n, p=[0.95, 0.03, 0.02])
    return pd.DataFrame({"k": k, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, "s"), "id": np.arange(n), "v": rng.random(n).round(6)})


def frames(spark):
    t = skewed()
    left, right = t[t.id % 3 > 0], t[(t.id % 3 == 0) & (t.ts.dt.day != 3)].drop_duplicates(["k", "ts"], keep="last")  # a day without right rows
    make = lambda x: spark.createDataFrame(x, "k string, ts timestamp_ntz, id long, v double")
    return left, right, make(left), make(right)


@pytest.mark.parametrize("seconds", [600, 86_400, 10**8])
def test_asof_joins_across_stretches(spark, seconds):
    left, right, a, b = frames(spark)
    for how, direction in ((asof.asof, "backward"), (asof.asof_next, "forward")):
        for key in (["k"], []):
            r = right if key else right.drop_duplicates("ts", keep="last")
            rs = b if key else spark.createDataFrame(r, b.schema)
            got = how(a.select("k", "ts", "id"), rs.select(*key, "ts", F.col("v").alias("w")), key, ["w"], seconds=seconds).toPandas().sort_values("id").reset_index(drop=True)
            want = pd.merge_asof(left.sort_values("ts"), r[[*key, "ts", "v"]].rename(columns={"v": "w"}).sort_values("ts"), on="ts", by=key or None, direction=direction).sort_values("id")
            assert len(got) == len(left) and np.array_equal(got.w.to_numpy(), want.w.to_numpy(), equal_nan=True), (direction, key)


def test_asof_keeps_rows_with_null_keys_and_takes_the_tie(spark):
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(None, t, 1), ("a", t, 2), ("a", None, 3)], "k string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([(None, t, 5, 1), ("a", t, 6, 1), ("a", t, 7, 2)], "k string, ts timestamp_ntz, w int, o int")
    got = {r.id: r.w for r in asof.asof(left, right, ["k"], ["w"], tie=F.col("o")).collect()}
    assert got == {1: 5, 2: 7, 3: None}


@pytest.mark.parametrize("seconds", [600, 86_400])
def test_forward_fill_across_stretches(spark, seconds):
    t = skewed()
    t.loc[(t.id % 7 > 0) | (t.ts.dt.day == 4), "v"] = None
    df = spark.createDataFrame(t, "k string, ts timestamp_ntz, id long, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = asof.forward_fill(df, ["v"], ["k"], ["ts", "id"], seconds).toPandas().sort_values("id").v.to_numpy()
    assert np.array_equal(got, t.groupby("k").v.ffill().to_numpy(), equal_nan=True)


@pytest.mark.parametrize("size", [50, 10**6])
def test_bad_ticks_in_buckets(spark, size):
    t = skewed(1200).rename(columns={"k": "symbol", "v": "mid"})
    t["spread"] = 0.01
    df = spark.createDataFrame(t, "symbol string, ts timestamp_ntz, id long, mid double, spread double")
    got, want = (clean.bad_ticks(df, z=1.5, size=s).select("id", "is_bad", "mid").toPandas().sort_values("id").reset_index(drop=True) for s in (size, 10**7))
    assert len(got) == 1200 and got.is_bad.sum() > 20 and got.equals(want)


@pytest.mark.parametrize("cells", [4, 200])
def test_exact_quantiles(spark, cells):
    rng = np.random.default_rng(3)
    t = pd.DataFrame({"k": rng.choice(["hot", "b"], 4000, p=[0.95, 0.05]), "v": np.where(rng.random(4000) < 0.3, 5.0, rng.normal(0, 10, 4000).round(2))})
    t.loc[4000] = ["one", 7.0]
    df = spark.createDataFrame(t).unionByName(spark.createDataFrame([("none", None), ("one", None)], "k string, v double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in stats.exact_quantiles(df, "v", ["k"], shares, cells).collect()}
    assert set(got) == {"hot", "b", "one"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile(t.v[t.k == k], shares)), k
    assert np.allclose(stats.exact_quantiles(df, "v", [], shares, cells).first().q, np.quantile(t.v, shares))


def test_sums_in_value_order(spark):
    rng = np.random.default_rng(9)
    t = pd.DataFrame({"k": rng.choice(["hot", "b"], 3000, p=[0.95, 0.05]), "x": rng.normal(0, 5, 3000).round(2), "n": rng.integers(1, 9, 3000)}).drop_duplicates(["k", "x"])
    df = spark.createDataFrame(t, "k string, x double, n long").unionByName(spark.createDataFrame([(None, 1.0, 4)], "k string, x double, n long"))
    got = stats.in_value_order(df, ["k"], "x", ["n"], 20).toPandas().sort_values(["k", "x"]).reset_index(drop=True)
    want = t.sort_values(["k", "x"]).reset_index(drop=True)
    assert len(got) == len(want) + 1 and got.upto_n.iloc[-1] == 4
    assert (got.upto_n[:-1] == want.groupby("k").n.cumsum()).all()
    assert np.array_equal(got.next_value[:-1], want.groupby("k").x.shift(-1), equal_nan=True)


def test_series_are_dealt_out_by_time(spark):
    """With 95 % of the rows in one key, no task of the ordered frame holds more than a few times what others hold."""
    t = asof.celled(spark.createDataFrame(skewed(20_000)), ["k"], "ts", 3600)
    sizes = t.repartition(16, "_at").withColumn("p", F.spark_partition_id()).groupBy("p").count().toPandas()["count"]
    assert len(sizes) > 8 and sizes.max() < 4 * sizes.median()


def test_joins_to_the_next_row_read_each_row_once(spark, capsys):
    """A frame that ends with its partition is gone through anew for every row: quadratic in a stretch."""
    a, b = frames(spark)[2:]
    asof.asof_next(a.select("k", "ts", "id"), b.select("k", "ts", F.col("v").alias("w")), ["k"], ["w"]).explain(True)
    asof.nearness(a, b, 60.0, 3.0).explain(True)
    asof.in_event_windows(a, b, 15, 30).explain(True)
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_stability_index_looks_edges_up_where_the_rows_are(spark, capsys):
    """Few keys hold all rows: joined by a shuffle they would meet in as few tasks."""
    df = frames(spark)[2].select("k", F.col("v").alias("x"), (F.col("id") % 2 == 0).alias("live"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kind in ("quantile", "minmax"):
            stats.psi(df, "x", ["k"], F.col("live"), kind=kind).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_buckets_keep_null_symbols_and_times(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(s, w, i) for i, (s, w) in enumerate([(None, t), ("a", None), ("a", t), (None, None)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int")
    assert sorted(r.id for r in bars.in_buckets(df, 1, 10, ("ts", "id")).filter("not halo").collect()) == [0, 1, 2, 3]


def test_trade_monitor_deals_flags_into_buckets(spark, sf_dir, capsys):
    from tidemark.plans import catalog

    catalog.queries()["ST13_trade_monitor"](spark, sf_dir).explain()
    assert "bucket" in capsys.readouterr().out
