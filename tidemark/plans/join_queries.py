"""Queries for joins and set operations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.operators import asof as J
from tidemark.operators.bars import time_bars
from tidemark.plans.sql import BARS, TICKS
from tidemark.sources.tables import read, ticks

QUERIES, SQL = {}, {}
EVENTS = "ev AS (SELECT DISTINCT ts FROM ticks WHERE symbol = 'error')"


def add(name, sql, digits=6):
    def put(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        SQL[name] = sql
        return f

    return put


@add("J1_asof", f"""WITH {TICKS},
    v AS (SELECT user_key, ts, max_by(mid, id) AS seen, max(id) AS mid_id FROM (SELECT e.user_id % 50 AS user_key, t.*
        FROM ticks t JOIN events e ON e.event_id = t.id) WHERE symbol = 'view' GROUP BY ALL),
    p AS (SELECT e.user_id % 50 AS user_key, t.ts, t.id, t.mid FROM ticks t JOIN events e ON e.event_id = t.id WHERE symbol = 'purchase')
    SELECT p.id, p.user_key, p.ts, round(p.mid, 6) + 0.0 AS mid, round(v.seen, 6) + 0.0 AS seen FROM p ASOF LEFT JOIN v ON p.user_key = v.user_key AND p.ts >= v.ts + INTERVAL 1 MINUTE""")
def j1(spark, d):
    """The last view of the same user group that was known (a minute after it happened) at each purchase."""
    e = read(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("user_key"), "event_type", F.col("value"))
    views = e.filter("event_type = 'view'").groupBy("user_key", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts")).agg(F.max_by("value", "event_id").alias("seen"))
    left = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_key", "ts", F.col("value").alias("mid"))
    return J.asof(left, views, ["user_key"], ["seen"])


@add("J2_next_event", f"""WITH {BARS}, {EVENTS}, b AS (SELECT symbol, ts FROM bars WHERE symbol <> 'error'),
    n AS (SELECT b.*, ev.ts AS nx FROM b ASOF LEFT JOIN ev ON b.ts <= ev.ts), p AS (SELECT n.*, ev.ts AS pv FROM n ASOF LEFT JOIN ev ON n.ts >= ev.ts)
    SELECT symbol, ts, least(coalesce(epoch_us(nx) - epoch_us(ts), 86400000000), 86400000000) AS us_to, least(coalesce(epoch_us(ts) - epoch_us(pv), 86400000000), 86400000000) AS us_since FROM p""")
def j2(spark, d):
    """Microseconds to the next and since the last release, at most a day; releases are error events, known to all symbols."""
    t = ticks(spark, d)
    events = t.filter("symbol = 'error'").select("ts").distinct()
    b = time_bars(t).filter("symbol <> 'error'").select("symbol", "ts")
    both = J.asof_next(J.asof(b, events, [], [], keep_time="pv"), events, [], [], keep_time="nx")
    day = F.lit(86_400_000_000)
    away = lambda a, z: F.least(F.coalesce(F.unix_micros(z.cast("timestamp")) - F.unix_micros(a.cast("timestamp")), day), day)
    return both.select("symbol", "ts", away(F.col("ts"), F.col("nx")).alias("us_to"), away(F.col("pv"), F.col("ts")).alias("us_since"))


@add("J3_asof_tolerance", f"""WITH {TICKS},
    v AS (SELECT ts, max_by(mid, id) AS anchor FROM ticks WHERE symbol = 'view' GROUP BY ts),
    p AS (SELECT id, ts FROM ticks WHERE symbol = 'purchase')
    SELECT p.id, p.ts, CASE WHEN v.ts >= p.ts - INTERVAL 10 MINUTE THEN round(v.anchor, 6) + 0.0 END AS anchor FROM p ASOF LEFT JOIN v ON p.ts >= v.ts""")
def j3(spark, d):
    t = ticks(spark, d)
    views = t.filter("symbol = 'view'").groupBy("ts").agg(F.max_by("mid", "id").alias("anchor"))
    return J.asof(t.filter("symbol = 'purchase'").select("id", "ts"), views, [], ["anchor"], tolerance="10 MINUTES")


@add("J4_label_features", """SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def j4(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id")


@add("J5_left_ffill", f"""WITH {BARS},
    e AS (SELECT ts, max(mid) AS level FROM bars JOIN (SELECT time_bucket(INTERVAL '6 hours', ts) AS bts, mid FROM ticks
        WHERE symbol = 'signup' AND mid > 300) s ON s.bts = bars.ts GROUP BY ts)
    SELECT symbol, ts, round(last_value(level IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS level FROM bars LEFT JOIN e USING (ts)""")
def j5(spark, d):
    t = ticks(spark, d)
    levels = t.filter("symbol = 'signup' and mid > 300").groupBy(F.window("ts", "6 hours").start.alias("ts")).agg(F.max("mid").alias("level"))
    return J.forward_fill(time_bars(t).select("symbol", "ts").join(levels, "ts", "left"), ["level"], ["symbol"], ["ts"]).select("symbol", "ts", "level")


@add("J6_full_outer", f"""WITH {TICKS},
    a AS (SELECT date_trunc('hour', ts) AS h, avg(mid) AS actual FROM ticks WHERE symbol = 'click' GROUP BY 1),
    f AS (SELECT date_trunc('hour', ts) AS h, avg(mid) AS forecast FROM ticks WHERE symbol = 'view' GROUP BY 1)
    SELECT coalesce(a.h, f.h) AS ts, round(actual, 6) + 0.0 AS actual, round(forecast, 6) + 0.0 AS forecast FROM a FULL JOIN f ON a.h = f.h""")
def j6(spark, d):
    t = ticks(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    hourly = lambda s, n: t.filter(F.col("symbol") == s).groupBy("ts").agg(F.avg("mid").alias(n))
    return hourly("click", "actual").join(hourly("view", "forecast"), "ts", "full")


@add("J7_common_times", f"""WITH {BARS} SELECT ts, round(max(CASE WHEN symbol = 'click' THEN close END), 6) + 0.0 AS click, round(max(CASE WHEN symbol = 'view' THEN close END), 6) + 0.0 AS view FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = 5""")
def j7(spark, d):
    b = time_bars(ticks(spark, d)).withColumn("id", F.col("n"))
    return J.common_times(b, 5).select("ts", F.col("values")["click"].alias("click"), F.col("values")["view"].alias("view"))


@add("J8_event_windows", f"""WITH {TICKS}, ev AS (SELECT DISTINCT ts AS e FROM ticks WHERE symbol = 'error')
    SELECT t.id, t.ts, coalesce(max(CAST(e > t.ts AS INT)), 0) AS near_before, coalesce(max(CAST(e <= t.ts AS INT)), 0) AS near_after
    FROM ticks t LEFT JOIN ev ON e BETWEEN t.ts - INTERVAL 30 MINUTE AND t.ts + INTERVAL 15 MINUTE WHERE t.symbol <> 'error' GROUP BY t.id, t.ts""")
def j8(spark, d):
    t = ticks(spark, d)
    return J.in_event_windows(t.filter("symbol <> 'error'").select("id", "ts"), t.filter("symbol = 'error'"), 15, 30)


@add("J9_event_to_bar", f"""WITH {BARS} SELECT t.id, b.symbol, b.ts AS bar_ts FROM ticks t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.ts >= b.ts""")
def j9(spark, d):
    t = ticks(spark, d)
    return J.asof(t.select("symbol", "ts", "id"), time_bars(t).select("symbol", "ts"), ["symbol"], [], keep_time="bar_ts").select("id", "symbol", "bar_ts")


@add("J10_remaining", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j10(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@add("J11_coalesce_update", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j11(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@add("J12_dimension", """SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def j12(spark, d):
    """Two small tables looked up; Spark broadcasts them by their size."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@add("J13_nearest_boost", f"""WITH {TICKS}, a AS (SELECT DISTINCT ts AS e FROM ticks WHERE symbol = 'error')
    SELECT t.id, round(coalesce(max(1.0 + 2.0 * (1 - abs(epoch(t.ts - e)) / 900.0)), 1.0), 9) + 0.0 AS weight FROM ticks t LEFT JOIN a ON e BETWEEN t.ts - INTERVAL 15 MINUTE AND t.ts + INTERVAL 15 MINUTE WHERE t.symbol <> 'error' GROUP BY t.id""", 9)
def j13(spark, d):
    """Rows near an anchor weigh more, the nearer the more."""
    t = ticks(spark, d)
    return J.nearness(t.filter("symbol <> 'error'").select("id", "ts"), t.filter("symbol = 'error'"), 900.0, 3.0).select("id", "weight")


@add("J14_session_gap", f"""WITH {TICKS},
    day AS (SELECT symbol, CAST(ts AS DATE) AS day, last(mid ORDER BY ts, id) FILTER (hour(ts) < 8) AS asia, first(mid
        ORDER BY ts, id) FILTER (hour(ts) BETWEEN 8 AND 15) AS london, min(ts) FILTER (hour(ts) BETWEEN 8 AND 15) AS ts
        FROM ticks GROUP BY ALL)
    SELECT symbol, ts, round(london - asia, 6) + 0.0 AS gap FROM day WHERE ts IS NOT NULL""")
def j14(spark, d):
    """The gap from the last Asian price to the first of London, at the time of the latter."""
    at, h = F.struct("ts", "id"), F.hour("ts")
    asia, london = h < 8, (h >= 8) & (h < 16)
    day = ticks(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.max_by(F.when(asia, F.col("mid")), F.when(asia, at)).alias("a"), F.min_by(F.when(london, F.col("mid")), F.when(london, at)).alias("l"), F.min(F.when(london, F.col("ts"))).alias("ts"))
    return day.filter("ts is not null").select("symbol", "ts", (F.col("l") - F.col("a")).alias("gap"))


@add("J15_overlap", """WITH t AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1),
    x AS (SELECT * FROM t WHERE l_orderkey % 10 = 0)
    SELECT t.l_orderkey FROM t WHERE l_orderkey % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM x WHERE x.a <= t.b AND t.a <= x.b AND x.l_orderkey % 100 = t.l_orderkey // 10 % 10 * 10)""")
def j15(spark, d):
    """Training ranges that overlap no test range of their group: purging, as an anti-join on equal group and overlap."""
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    x = t.filter("l_orderkey % 10 = 0").select((F.col("l_orderkey") % 100).alias("g"), F.col("a").alias("xa"), F.col("b").alias("xb"))
    own = t.filter("l_orderkey % 10 <> 0").withColumn("g", F.floor(F.col("l_orderkey") / 10) % 10 * 10)
    return own.join(x, (own.g == x.g) & (F.col("xa") <= F.col("b")) & (F.col("a") <= F.col("xb")), "left_anti").select("l_orderkey")


@add("O1_sorted", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) % 2 AS odd FROM events")
def o1(spark, d):
    """A global order by range partitions; a row's number is its part's offset plus its place, not one task's count."""
    e = read(spark, d, "events").select("event_id", "ts").withColumn("day", F.to_date("ts"))
    from pyspark.sql import Window

    offsets = e.groupBy("day").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")) + F.col("before")
    return e.join(offsets.select("day", "before"), "day").select("event_id", "ts", (nth % 2).alias("odd"))


@add("O2_newest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def o2(spark, d):
    return read(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@add(
    "O3_top_per_key",
    """SELECT o_custkey, o_orderkey, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rk
        FROM orders) WHERE rk <= 3""",
)
def o3(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, d, "orders").withColumn("rk", F.row_number().over(w)).filter("rk <= 3").select("o_custkey", "o_orderkey", "rk")


@add("O4_union_all", "SELECT 'doc' AS kind, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'turn', conv_id, length(text) FROM conversations")
def o4(spark, d):
    return read(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")).unionByName(
        read(spark, d, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.length("text").cast("long").alias("n")))


@add(
    "O5_keep_first",
    """SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id
    FROM events GROUP BY ALL""",
)
def o5(spark, d):
    at = F.struct("ts", "event_id")
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"))


@add("O6_set_operations", """WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'),
    p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
    SELECT user_id, 'both' AS what FROM (SELECT * FROM c INTERSECT SELECT * FROM p) UNION ALL SELECT user_id, 'click only' FROM (SELECT * FROM c EXCEPT SELECT * FROM p)""")
def o6(spark, d):
    e = read(spark, d, "events")
    users = lambda k: e.filter(F.col("event_type") == k).select("user_id")
    return users("click").intersect(users("purchase")).withColumn("what", F.lit("both")).unionByName(users("click").subtract(users("purchase")).withColumn("what", F.lit("click only")))
