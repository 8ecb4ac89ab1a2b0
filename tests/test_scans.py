"""Prefix scans and order statistics that are dealt out, against loops and numpy on a table in which one key has most rows."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, scans, stats


def skewed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 5 * 86_400, n))
    k = rng.choice(["hot", "b", "c"], n, p=[0.95, 0.03, 0.02])
    return pd.DataFrame({"k": k, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, "s"), "id": np.arange(n), "v": rng.normal(0, 1, n).round(6)})


def frame(spark, t):
    df = spark.createDataFrame(t, "k string, ts timestamp_ntz, id long, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.withColumn("cell", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473_000)


@pytest.mark.parametrize("cell", ["to_date(ts)", "date_trunc('hour', ts)", "1"])
def test_running_totals_in_cells(spark, cell):
    t = skewed()
    t.loc[t.id % 7 == 0, "v"] = None
    t.loc[t.id % 11 == 0, "k"] = None
    got = scans.running(frame(spark, t), ["k"], ["ts", "id"], F.expr(cell), {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}).toPandas().sort_values("id")
    by = t.groupby("k", dropna=False).v
    for name, want in (("s", by.cumsum()), ("lo", by.cummin()), ("hi", by.cummax())):
        seen = t.v.notna().to_numpy()  # pandas gives nothing where the value is missing
        assert np.allclose(got[name].to_numpy(float)[seen], want.to_numpy()[seen])
    assert (got.n.to_numpy() == t.v.notna().groupby(t.k.fillna("?")).cumsum().to_numpy()).all()
    first = got[got.k.isna()].iloc[0]
    assert first.n == int(first.v == first.v)


def walked(v, delta):
    out, total, s, low = [], 0.0, 0.0, 0.0
    for n, x in enumerate(v, 1):
        total += x
        s += x - total / n - delta
        low = min(low, s)
        out.append(s - low)
    return out


def test_page_hinkley_ddm_and_drawdown_in_cells(spark):
    t = skewed()
    df = frame(spark, t)
    ph = stats.page_hinkley(df, "v", ["k"], ["ts", "id"], 0.01, 5.0).toPandas().sort_values("id")
    dd = stats.drawdowns(df.withColumn("r", F.col("v") / 100), "r", ["k"], ["ts", "id"], F.to_date("ts")).toPandas().sort_values("id")
    level = stats.ddm(df.withColumn("e", (F.col("v") > F.col("id") / 1500 - 1).cast("int")), "e", ["k"], ["ts", "id"]).toPandas().sort_values("id")
    for k, rows in t.groupby("k"):
        assert np.allclose(ph.ph[ph.k == k].to_numpy(), walked(rows.v, 0.01))
        equity = np.cumprod(1 + rows.v.to_numpy() / 100)
        assert np.allclose(dd.drawdown[dd.k == k].to_numpy(), equity / np.maximum(np.maximum.accumulate(equity), 1) - 1)
        n, wrong, best, want = 0, 0, None, []
        for v, i in zip(rows.v, rows.id):
            n, wrong = n + 1, wrong + int(v > i / 1500 - 1)
            p = wrong / n
            s = (p * (1 - p) / n) ** 0.5
            if n >= 30 and (best is None or (p + s, p, s) < best):
                best = (p + s, p, s)
            want.append(0 if best is None else 2 if p + s > best[1] + 3 * best[2] else 1 if p + s > best[1] + 2 * best[2] else 0)
        assert level.level[level.k == k].tolist() == want


@pytest.mark.parametrize("fan", [2, 7, 1024])
def test_exponential_mean_over_a_tree_of_cells(spark, fan):
    t = skewed(800)
    t.loc[t.id % 9 == 0, "v"] = None
    got = scans.exponential_mean(frame(spark, t), "v", 12, ["k"], ["ts", "id"], "cell", fan=fan).toPandas().sort_values("id")
    for k, rows in t.groupby("k"):
        s, want = None, []
        for v in rows.v:
            s = s if v != v else v if s is None else s + (v - s) * 2 / 13
            want.append(np.nan if s is None else s)
        assert np.allclose(got.ema[got.k == k].to_numpy(float), want, equal_nan=True)


def test_any_algebra_scans(spark):
    t = skewed(1200)
    lift = lambda pdf: np.column_stack([pdf.v, np.minimum(pdf.v, 0)])
    got = scans.scan(frame(spark, t), ["k"], ["ts", "id"], "cell", scans.WALK, lift, {"above": lambda e: e[:, 0] - e[:, 1]}, fan=5).toPandas().sort_values("id")
    for k, rows in t.groupby("k"):
        s = rows.v.cumsum().to_numpy()
        assert np.allclose(got.above[got.k == k].to_numpy(), s - np.minimum(np.minimum.accumulate(s), 0))


def test_a_million_cells_of_one_key(spark):
    """Starts of cells: no row and no task holds more than a node of the tree."""
    n = 1_000_000
    totals = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("cell"), F.array(F.lit(0.5), (F.col("id") % 97).cast("double")).alias("total"))
    got = scans.starts(totals, ["k"], scans.AFFINE)
    some = {r.cell: r.start for r in got.filter("cell in (0, 1, 1023, 1024, 1025, 500000, 999999)").collect()}
    s, want = 0.0, {}
    for i in range(n):
        if i in some:
            want[i] = s
        s = s * 0.5 + i % 97
    assert got.count() == n and some[0] == [1.0, 0.0] and all(abs(some[i][1] - want[i]) < 1e-9 for i in some)


def test_long_ema_of_the_query_equals_pandas(spark):
    t = skewed(500).rename(columns={"k": "symbol"})
    t["row"] = t.groupby("symbol").cumcount()
    df = spark.createDataFrame(t, "symbol string, ts timestamp_ntz, id long, v double, row long").withColumn("bucket", F.floor(F.col("row") / 7))
    got = models.long_ema(df, "v", 9).toPandas().sort_values(["symbol", "ts"])
    want = t.sort_values(["symbol", "row"]).groupby("symbol").v.transform(lambda v: v.ewm(span=9, adjust=False).mean())
    assert np.allclose(np.sort(got.ema.to_numpy()), np.sort(want.to_numpy()))


# order statistics


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles_equal_numpy(spark, accuracy):
    """Ties, a hot value, few and many rows a key; at a low accuracy the brackets are what decides."""
    t = skewed(6000)
    t.loc[t.id % 3 == 0, "v"] = 0.25
    t.loc[t.id % 13 == 0, "v"] = None
    t.loc[t.id % 17 == 0, "k"] = None
    shares = [0.0, 0.01, 0.25, 0.5, 0.503, 0.9, 1.0]
    got = {r.k: list(r.q) for r in stats.exact_quantiles(frame(spark, t), "v", ["k"], shares, accuracy).collect()}
    for k, rows in t.groupby("k", dropna=False):
        assert np.allclose(got[None if k != k else k], np.quantile(rows.v.dropna(), shares))
    whole = stats.exact_quantiles(frame(spark, t), "v", [], shares, accuracy).first().q
    assert np.allclose(list(whole), np.quantile(t.v.dropna(), shares))


def test_quantiles_of_nothing_and_of_one(spark):
    t = pd.DataFrame({"k": ["a", "b", "b"], "ts": pd.Timestamp("2024-01-01"), "id": [1, 2, 3], "v": [2.0, None, None]})
    got = stats.with_quantiles(frame(spark, t), "v", ["k"], {"m": 0.5}).collect()
    assert sorted((r.id, r.m) for r in got) == [(1, 2.0), (2, None), (3, None)]


def test_drawdown_of_an_equity_beyond_doubles_is_as_in_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rise, fall = 1e100, -0.5
    rows = [(n, 1, "A", x, datetime(2024, 1, 1) + timedelta(n)) for n, x in enumerate([0.1, fall, rise, rise, rise, 1e10, fall, -0.9, -0.9])]
    rows += [(n, 1, "B", x, datetime(2024, 1, 1) + timedelta(n)) for n, x in enumerate([0.1, fall, rise, 0.3, fall])]
    t = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_discount double, l_shipdate timestamp_ntz")
    t.write.parquet(f"{tmp_path}/lineitem.parquet")
    sql = entry.oracle_sql()["T18_performance"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"SELECT l_returnflag, max_drawdown, calmar FROM ({sql}) ORDER BY 1").fetchall()
    got = entry.queries()["T18_performance"](spark, str(tmp_path)).orderBy("l_returnflag").collect()
    assert want[0][1] == -1.0 and [r.l_returnflag for r in got] == ["A", "B"]
    assert [r.max_drawdown for r in got] == pytest.approx([w[1] for w in want], abs=1e-6)
    in_logs = stats.performance(t.withColumn("r", F.col("l_discount")), ["l_returnflag"], ["l_shipdate"]).filter("l_returnflag = 'B'").first()
    assert in_logs.max_drawdown == pytest.approx(-0.5)


def test_drawdowns_of_rows_that_tie_do_not_depend_on_their_arrival(spark):
    rng = np.random.default_rng(5)
    rows = [(datetime(2024, 1, 1) + timedelta(n // 20), float(r)) for n, r in enumerate(rng.normal(0, 0.1, 400))]
    one, two = (stats.drawdowns(spark.createDataFrame(x, "ts timestamp_ntz, r double").withColumn("k", F.lit(1)), "r", ["k"], ["ts"]).orderBy("ts", "r").toPandas() for x in (rows, rows[::-1]))
    equity = np.cumsum(np.log1p([r for _, r in sorted(rows)]))
    assert np.allclose(one.drawdown, np.exp(equity - np.maximum(np.maximum.accumulate(equity), 0)) - 1)
    assert np.allclose(one.drawdown, two.drawdown)
