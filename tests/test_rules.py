"""Hand-worked frames: full windows, ties, look-ahead, summer time, empty streams and odd bars."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.frames import Roll, layers
from tidemark.operators import asof, bars, clean, governance, indicators, labels, stats
from tidemark.sources import store
from tidemark.streaming import jobs


def at(minute, day=2):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)


@pytest.fixture
def prices(spark):
    def make(closes, symbol="s"):
        rows = [(symbol, at(i), float(x), float(x) + 1, float(x) - 1, float(x), 10.0, 0.02, float(x) - 0.01, float(x) + 0.01) for i, x in enumerate(closes)]
        return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, spread double, bid_close double, ask_close double")

    return make


def test_windows_are_null_until_full_of_values(spark):
    df = spark.createDataFrame([("s", at(i), x) for i, x in enumerate([1.0, None, 3.0, 4.0, 5.0])], "symbol string, ts timestamp_ntz, x double")
    got = [r.m for r in df.withColumn("m", Roll(3).avg(F.col("x"))).orderBy("ts").collect()]
    assert got == [None, None, None, None, 4.0]
    assert [r.m for r in df.withColumn("m", Roll(3, 1).avg(F.col("x"))).orderBy("ts").collect()] == [1.0, 1.0, 2.0, 3.5, 4.0]


def test_ties_in_bars_follow_the_id(spark):
    t = spark.createDataFrame([("s", at(0), i, float(v), 1.0, 0.01, v - 0.005, v + 0.005) for i, v in ((2, 5), (1, 9), (3, 7))], "symbol string, ts timestamp_ntz, id long, mid double, volume double, spread double, bid double, ask double")
    r = bars.time_bars(t).first()
    assert (r.open, r.high, r.low, r.close, r.n) == (9.0, 9.0, 5.0, 7.0, 3)
    assert [(r.bar, r.n) for r in bars.activity_bars(t, F.lit(1.0), 2).orderBy("bar").collect()] == [(0, 2), (1, 1)]
    assert bars.activity_bars(t, F.lit(1.0), 2, whole_only=True).count() == 1


def test_asof_sees_a_value_only_once_it_is_known(spark):
    left = spark.createDataFrame([("s", at(i)) for i in range(3)], "k string, ts timestamp_ntz")
    right = spark.createDataFrame([("s", at(1), 0.9), ("s", at(1), None), ("t", at(0), 5.0)], "k string, ts timestamp_ntz, v double")
    got = [r.v for r in asof.asof(left, right.filter("v is not null"), ["k"], ["v"]).orderBy("ts").collect()]
    assert got == [None, 0.9, 0.9]
    late = asof.asof(left, right.filter("v is not null"), ["k"], ["v"], tolerance="30 SECONDS").orderBy("ts").collect()
    assert [r.v for r in late] == [None, 0.9, None]
    ahead = asof.asof_next(left, right.filter("v is not null"), ["k"], ["v"]).orderBy("ts").collect()
    assert [r.v for r in ahead] == [0.9, 0.9, None]


@pytest.mark.parametrize("f", [indicators.atr, indicators.macd, indicators.bollinger, indicators.rsi, indicators.vwap_bands, indicators.volatility_terciles, indicators.directional_regime])
def test_no_indicator_looks_ahead(prices, f):
    closes = [100 + 5 * math.sin(i / 3) + (i % 7) for i in range(90)]
    whole, cut = f(prices(closes)), f(prices(closes[:70]))
    a = whole.filter(F.col("ts") < F.lit(at(70)).cast("timestamp_ntz")).orderBy("ts").collect()
    assert a == cut.orderBy("ts").collect()


def test_halo_windows_equal_whole_windows(prices):
    df = prices([100 + 3 * math.sin(i) for i in range(200)])
    from pyspark.sql import Window

    split = bars.in_buckets(df, back=9, size=32)
    w = Window.partitionBy("symbol", "bucket").orderBy("ts").rowsBetween(-9, 0)
    got = split.withColumn("m", F.when(F.count("close").over(w) >= 10, F.avg("close").over(w))).filter("not halo").select("ts", "m")
    want = df.select("ts", Roll(10).avg(F.col("close")).alias("m"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_barriers(prices):
    up = labels.triple_barrier(prices(range(100, 130)).withColumn("atr_6", F.lit(1.0)), horizon=5).filter("tb_label is not null")
    assert {r.tb_label for r in up.collect()} == {1} and up.count() == 24
    down = labels.triple_barrier(prices(range(130, 100, -1)).withColumn("atr_6", F.lit(1.0)), horizon=5).filter("tb_label is not null")
    assert {r.tb_label for r in down.collect()} == {-1}
    flat = labels.triple_barrier(prices([100] * 20).withColumn("atr_6", F.lit(1.0)), horizon=5).filter("tb_label is not null")
    assert {r.tb_label for r in flat.collect()} == {0}
    wide = prices([100, 100, 100]).withColumns({"atr_6": F.lit(0.5), "low": F.lit(90.0), "high": F.lit(110.0)})
    assert labels.executable_utility(wide, horizon=2).orderBy("ts").first().utility == pytest.approx(-0.4)  # both barriers in one bar: the stop first


def test_sessions_follow_summer_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 8, 14, 0),), (dt.datetime(2024, 3, 11, 14, 0),), (dt.datetime(2024, 3, 29, 7, 30),), (dt.datetime(2024, 4, 1, 7, 30),)], "ts timestamp_ntz")
    got = clean.local_sessions(df).orderBy("ts").collect()
    assert [r.in_new_york for r in got] == [0, 1, 0, 0] and [r.in_london for r in got] == [1, 1, 0, 1]


def test_unit_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("148K", "0.3%", "-5.9B", " 2 M ", "n/a", "", None)], "x string")
    assert [r[0] for r in df.select(clean.unit_number(F.col("x"))).collect()] == [148e3, pytest.approx(0.003), -5.9e9, 2e6, None, None, None]


def test_drift_of_equal_and_moved_samples(spark):
    df = spark.range(2000).select(F.lit("f").alias("feature"), (F.col("id") % 1000 / 100).alias("x"), (F.col("id") >= 1000).alias("live"))
    same, moved = (stats.two_samples(x, "x", ["feature"], F.col("live")).first() for x in (df, df.withColumn("x", F.col("x") + F.when(F.col("live"), 2).otherwise(0))))
    assert same.ks == 0 and same.p_value == 1 and moved.ks == pytest.approx(0.2, abs=0.002) and moved.wasserstein == pytest.approx(2) and moved.p_value < 1e-6
    assert stats.psi(df, "x", ["feature"], F.col("live")).first().psi == pytest.approx(0)


def test_contract_counts_breaches(spark):
    df = spark.createDataFrame([("click", at(0), 10.0, 10.1, 10.05, 0.1, 1.0), ("odd", at(1), 10.2, 10.1, 10.05, 0.1, -1.0), (None, at(2), 1.0, 1.1, 1.05, 0.1, None)], "symbol string, ts timestamp_ntz, bid double, ask double, mid double, spread double, volume double")
    tick = governance.tick_contract(["click", "error", "purchase", "signup", "view"], (5.0, 480.0))
    got = {r.rule: r.violations for r in tick.check(df).collect()}
    assert got["not_null:symbol"] == 1 and got["bounds:mid"] == 1 and got["bounds:volume"] == 1 and got["allowed:symbol"] == 1 and got["invariant:uncrossed"] == 1
    assert {r.rule for r in tick.check(df.drop("volume").withColumn("volume", F.lit("x"))).filter("rule like 'schema%'").collect()} == {"schema:volume"}
    assert {(r.column, r.change) for r in governance.schema_drift({"a": "int", "b": "string"}, df.sparkSession.range(1).selectExpr("cast(id as string) as b", "id as c", "1 as a")).collect()} == {("c", "added")}


def test_splits_keep_their_distance(spark):
    df = governance.numbered(spark.range(100).withColumnRenamed("id", "k"), ["k"], F.floor(F.col("k") / 7))
    assert [r.row for r in df.orderBy("k").collect()] == list(range(100))
    w = governance.walk_forward(df, 3, 0.4, 0.2, 5)
    for fold in range(3):
        r = {x.role: (x.lo, x.hi) for x in w.filter(F.col("fold") == fold).groupBy("role").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).collect()}
        assert r["train"][1] == r["validate"][0] - 6
    c = governance.combinatorial(df, 5, 2, 3)
    assert c.select("fold").distinct().count() == 10
    train, test = c.filter("fold = 0 and role = 'train'"), c.filter("fold = 0 and role = 'test'")
    assert train.join(test.select(F.col("row").alias("t")), F.abs(F.col("row") - F.col("t")) < 4).count() == 0


def test_fingerprint_ignores_order(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    assert governance.fingerprint(df).first() == governance.fingerprint(df.orderBy(F.desc("id")).repartition(7)).first() != governance.fingerprint(df.filter("id <> 5")).first()


def test_results_do_not_depend_on_partitions(spark, prices):
    df = layers(prices([100 + i % 11 for i in range(120)]), {})
    first = indicators.volatility(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, indicators.volatility(df.repartition(9)).collect())) == sorted(map(str, first))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_equals_batch_over_several_files_and_drops_late_rows(spark, tmp_path):
    schema = "symbol string, ts timestamp, id long, mid double, spread double, volume double"
    rows = [("s", dt.datetime(2024, 1, 2, 0, i, 10, tzinfo=dt.timezone.utc), i, float(i), 0.01, 1.0) for i in range(12)]
    late = ("s", dt.datetime(2024, 1, 2, 0, 0, 30, tzinfo=dt.timezone.utc), 99, 1.0, 0.01, 1.0)
    for k, part in enumerate((rows[:6], rows[6:], [late])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in" / "*"))
    out = jobs.to_files(jobs.windowed(stream, "1 minute"), str(tmp_path / "w"))
    assert out.filter("n > 1").count() == 0 and out.count() >= 10
    state = jobs.to_files(jobs.keyed_state(stream, jobs.ema_step(3), [0.0] * 4, ["ema", "mean", "std"]), str(tmp_path / "s"))
    got, ema = {r.id: r.ema for r in state.collect()}, 0.0
    assert set(got) == set(range(11))  # the last tick waits for the watermark, the late one is left out
    for i in range(11):
        ema = float(i) if i == 0 else (ema + i) / 2
        assert got[i] == pytest.approx(ema)


def test_incremental_refresh_touches_changed_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    first = store.refresh(df, path, None, "k", ["v"])
    first.write.parquet(path + "-m")
    before = {r[0] for r in spark.read.parquet(path).filter("k <> 1").select(F.input_file_name()).distinct().collect()}
    store.refresh(df.filter("k <> 1 or v > 30"), path, spark.read.parquet(path + "-m"), "k", ["v"])
    spark.catalog.refreshByPath(path)
    again = spark.read.parquet(path)
    assert again.filter("k = 1").count() == 10 and again.count() == 50
    assert {r[0] for r in again.filter("k <> 1").select(F.input_file_name()).distinct().collect()} == before


def test_gate_scores_every_week_after_the_first_by_earlier_ones(spark, tmp_path):
    from tidemark.plans import catalog

    hours = spark.range(61 * 4).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int") * 6)).cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), (100 + 9 * F.sin(F.col("id") * 1.3)).alias("value"), F.lit('{"k": 1}').alias("props"))
    hours.write.parquet(str(tmp_path / "events.parquet"))
    days = {r.ts.date() for r in catalog.queries()["W74_gate"](spark, str(tmp_path)).select("ts").collect()}
    assert {dt.date(2024, 1, 29), dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 29)} <= days and len(days) >= 50


def test_refresh_sees_repeated_rows_and_vanished_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    before = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c/d", 3), (None, 4)], "k string, v int")
    after = spark.createDataFrame([("a", 9), ("a", 9), ("b", 2), (None, 4)], "k string, v int")
    manifest = store.refresh(before, path, None, "k", ["v"])
    assert spark.read.parquet(path).count() == 5
    store.refresh(after, path, manifest, "k", ["v"])
    spark.catalog.refreshByPath(path)
    assert sorted((str(r.k), r.v) for r in spark.read.parquet(path).collect()) == [("None", 4), ("a", 9), ("a", 9), ("b", 2)]


def test_event_windows_keep_equal_rows_and_rows_without_a_time(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("s", t(10), "x"), ("s", t(10), "x"), ("s", t(50), "y"), ("s", None, "z"), ("s", t(20), "w")], "k string, ts timestamp_ntz, note string")
    events = spark.createDataFrame([("s", t(20)), ("s", t(20))], "k string, ts timestamp_ntz")
    got = sorted((r.note, r.near_before, r.near_after) for r in asof.in_event_windows(rows, events, 15, 5, key=["k"]).collect())
    assert got == [("w", 0, 1), ("x", 1, 0), ("x", 1, 0), ("y", 0, 0), ("z", 0, 0)]


def test_ancestors_of_chains_diamonds_and_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(60)]
    diamonds = [e for i in range(24) for e in ((f"d{i}", f"l{i}"), (f"d{i}", f"r{i}"), (f"l{i}", f"d{i + 1}"), (f"r{i}", f"d{i + 1}"))]
    edges = spark.createDataFrame(chain + diamonds + [("x", "y"), ("y", "x")], "node string, needs string")
    got = {r.node: r.depth for r in governance.ancestors(edges, ["c0", "d0", "x"]).collect()}
    assert {n: d for n, d in got.items() if n[0] == "c"} == {f"c{i}": i for i in range(1, 61)}
    assert got["d24"] == 48 and got["l3"] == 7 and len(got) == 60 + 72 + 2 and (got["y"], got["x"]) == (1, 2)
    assert governance.ancestors(edges, ["nothing"]).count() == 0


def test_exports_of_several_forms(spark, tmp_path):
    forms = {
        "a": "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\n2024.01.02\t03:04:05\t1\t3\t0.5\t2\t7\n",
        "b": "20240102 03:04:05.123;1.99;2.01;7\nbroken;1;2;3\n",
        "c": "2024.01.02,03:04:05,1.99,2.01,7\n",
        "d": "timestamp_utc,ask,bid,spare,volume\n2024-01-02T03:04:05Z,2.01,1.99,x,7\n2024-01-02T03:04:06Z,,1.99,x,7\n",
        "e": "",
    }
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        got = [tuple(r) for r in store.read_export(spark, str(tmp_path / name), "S", 0.01).collect()]
        assert got == ([] if name == "e" else [("S", dt.datetime(2024, 1, 2, 3, 4, 5), pytest.approx(1.99), pytest.approx(2.01), 7.0)]), name
    with pytest.raises(ValueError):
        store.export_format("1,2")


def test_depth_is_scaled_and_inverted(spark):
    row = {"ts_event": "2024-01-02 00:00:00", "bid_px_00": 2e9, "ask_px_00": 4e9, "bid_sz_00": 3, "ask_sz_00": 5}
    df = spark.createDataFrame([row]).withColumn("ts_event", F.col("ts_event").cast("timestamp_ntz"))
    r = store.depth(df, "ts_event").first()
    assert (r.bid, r.ask, r.volume, r.mid, r.spread, len(r.levels)) == (2.0, 4.0, 4.0, 3.0, 2.0, 1)
    r = store.depth(df, "ts_event", inverted=True).first()
    assert (r.bid, r.ask) == (0.25, 0.5) and store.depth(df, "ts_event", "2024-01-03").count() == 0


def zero_bars(spark):
    """Eighty five-minute bars with zeros among lows, opens and closes."""
    rng = np.random.default_rng(4)
    b = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=80, freq="5min"), "open": rng.uniform(1, 9, 80), "close": rng.uniform(1, 9, 80)})
    b["high"], b["low"] = b[["open", "close"]].max(axis=1) + 1, b[["open", "close"]].min(axis=1) / 2
    b.loc[[30, 50], ["close", "low"]] = 0.0
    b.loc[45, ["open", "close", "high", "low"]] = 0.0
    return b, spark.createDataFrame(b, "symbol string, ts timestamp_ntz, open double, close double, high double, low double")


@pytest.mark.parametrize("name", ["W9_realized_spread", "W61_range_volatility", "W62_garman_klass", "W13_full_window"])
def test_zero_prices_as_in_sql(spark, name):
    import duckdb

    from tidemark.operators import indicators, order_stats
    from tidemark.functions.frames import log_return, rounded
    from tidemark.plans import catalog

    b, df = zero_bars(spark)
    con = duckdb.connect()
    con.register("bars_", b)
    sql = catalog.oracle_sql()[name]
    head, tail = sql[: sql.index("bars AS (")], sql[sql.index("FROM ticks GROUP BY ALL)") + len("FROM ticks GROUP BY ALL)") :]
    con.execute("CREATE VIEW events AS SELECT 'a' AS event_type, ts, 0 AS event_id, 1.0 AS value, '{}' AS props FROM bars_")
    rows = con.execute(f"{head} bars AS (SELECT * FROM bars_) {tail}").fetchall()
    want = [dict(zip([x[0] for x in con.description], r)) for r in rows]
    made = {
        "W9_realized_spread": indicators.realized_spread, "W61_range_volatility": indicators.range_volatility, "W62_garman_klass": indicators.implied_volatility,
        "W13_full_window": lambda x: order_stats.value_at_risk(x.withColumn("r", log_return()), "r")}[name](df)
    got = rounded(made.select(*want[0])).collect()
    key = lambda r: str(r["ts"])
    assert len(got) == 80 and [[str(v) for v in r.asDict().values()] for r in sorted(got, key=key)] == [[str(v) for v in r.values()] for r in sorted(want, key=key)]


def test_calendar_before_the_first_release_and_without_a_number_as_in_sql(spark, tmp_path):
    import duckdb

    from tidemark.operators import context
    from tidemark.plans import catalog

    events = [(0, at(0), "view", 3.0, '{"k": 1}'), (1, at(5), "error", 9.0, "{}"), (2, at(8), "view", 4.0, '{"k": 2}'), (3, at(20), "error", 7.0, '{"k": 900}'), (4, at(50), "click", 5.0, '{"k": 3}')]
    events += [(5, None, "error", 250.0, '{"k": 1}'), (6, None, "view", 5.0, '{"k": 1}')]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["W76_calendar"]).fetchall())
    names = [x[0] for x in con.description]
    assert sorted(map(tuple, catalog.queries()["W76_calendar"](spark, str(tmp_path)).select(*names).collect())) == want
    rows = spark.createDataFrame([(1, at(0)), (2, at(8)), (3, at(30))], "id int, ts timestamp_ntz")
    releases = spark.createDataFrame([(at(5), 9.0, None, 2.0), (at(20), 9.0, 1.0, 0.0)], "ts timestamp_ntz, actual double, forecast double, prior double")
    assert {r.surprise for r in context.calendar(rows, releases, 15).collect()} == {0.0}  # nothing is known, so nothing surprises
