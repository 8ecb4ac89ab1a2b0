"""Queries for fitted operators, reports and the rest of the inventory, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Roll, lag, layers, log_return, rounded
from tidemark.operators import asof as J
from tidemark.operators import bars as B
from tidemark.operators import governance as G
from tidemark.operators import indicators as I
from tidemark.operators import models as M
from tidemark.operators import order_stats
from tidemark.operators import stats as S
from tidemark.plans.indicator_queries import s_ema
from tidemark.plans.sql import BARS, TICKS, ret, roll
from tidemark.plans.sql import lag as slag
from tidemark.plans.stat_queries import CDF, FEATURES, RETURNS, melted, returns
from tidemark.plans.stat_queries import SQL as STAT_SQL
from tidemark.sources.tables import read, ticks
from tidemark.streaming import jobs

QUERIES, SQL = {}, {}


def c(name):
    return F.col(name)


def add(name, sql=None, digits=6):
    def put(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            SQL[name] = sql
        return f

    return put


def bars(spark, d):
    return B.time_bars(ticks(spark, d))


def windowed(source, x, n=64, step=8):
    """CTE w: symbol, ts, p (from 0) and v of the values in the window that ends at ts, for every step-th row."""
    return f"""n AS (SELECT symbol, ts, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM {source}),
    e AS (SELECT symbol, ts, i FROM n WHERE i % {step} = 0 AND i >= {n}),
    w AS (SELECT e.symbol, e.ts, n.i - e.i + {n - 1} AS p, n.x AS v FROM e JOIN n ON n.symbol = e.symbol AND n.i BETWEEN e.i - {n - 1} AND e.i)"""


@add(
    "W65_dfa",
    f"""WITH {RETURNS}, {windowed("r", "r")},
    c AS (SELECT *, v - avg(v) OVER (PARTITION BY symbol, ts) AS d FROM w),
    y AS (SELECT symbol, ts, p, sum(d) OVER (PARTITION BY symbol, ts ORDER BY p ROWS UNBOUNDED PRECEDING) AS y FROM c),
    b AS (SELECT symbol, ts, k, p // k AS box, greatest(regr_syy(y, p) - regr_sxy(y, p) ** 2 / regr_sxx(y, p), 0) AS rss
          FROM y, (SELECT unnest([4, 8, 16]) AS k) GROUP BY ALL),
    f AS (SELECT symbol, ts, k, sqrt(sum(rss) / 64) AS f FROM b GROUP BY ALL)
    SELECT symbol, ts, round(regr_slope(ln(f), ln(k)), 6) + 0.0 AS dfa FROM f WHERE f > 1e-12 GROUP BY 1, 2""",
)
def w65(spark, d):
    return M.fluctuation(returns(spark, d), "r")


@add(
    "W66_fractal",
    f"""WITH {BARS}, {windowed("bars", "close")}, ks AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k),
    m AS (SELECT a.symbol, a.ts, k, a.p % k AS m, sum(abs(b.v - a.v)) * 63.0 / max((63 - a.p % k) // k * k * k) AS len
          FROM w a JOIN ks ON true JOIN w b ON b.symbol = a.symbol AND b.ts = a.ts AND b.p = a.p + k GROUP BY ALL),
    l AS (SELECT symbol, ts, k, avg(len) AS len FROM m GROUP BY ALL)
    SELECT symbol, ts, round(least(greatest(-regr_slope(ln(len), ln(k)), 1.0), 2.0), 6) + 0.0 AS fractal_dimension FROM l WHERE len > 0 GROUP BY 1, 2""",
)
def w66(spark, d):
    return M.fractal_dimension(bars(spark, d), "close")


@add(
    "W66_segment_fractal",
    f"""WITH {BARS}, {windowed("bars", "close", 30, 1)}, ks AS (SELECT unnest(range(1, 15)) AS k),
    l AS (SELECT a.symbol, a.ts, k, avg(abs(b.v - a.v)) * 29.0 / (count(*) * max(k * k)) AS len
          FROM w a JOIN ks ON a.p % k = 0 AND a.p < 30 - k JOIN w b ON b.symbol = a.symbol AND b.ts = a.ts AND b.p = a.p + k GROUP BY ALL)
    SELECT symbol, ts, round(least(greatest(-regr_slope(ln(greatest(len, 1e-12)), ln(k)), 1.0), 2.0), 6) + 0.0 AS segment_dimension FROM l GROUP BY 1, 2""",
)
def w66_segment(spark, d):
    return M.segment_dimension(bars(spark, d), "close")


@add("W67_mixture")
def w67(spark, d):
    x = I.volatility(bars(spark, d).withColumn("r", log_return()), (20,)).dropna(subset=["r", "vol_20"])
    return M.mixture_regime(x, ["r", "vol_20"], c("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))


NAMES = ["click", "error", "purchase", "signup", "view"]


@add("W69_factors")
def w69(spark, d):
    panel = returns(spark, d).groupBy("ts").pivot("symbol", NAMES).agg(F.first("r")).dropna()
    return M.common_factors(panel, NAMES, 30, 10).select("ts", "share_1", "share_2")


COVS = ", ".join(f"covar_pop({p}, {q}) AS {p}{q}" for p, q in (("y", "y"), ("y", "y1"), ("y", "x1"), ("y1", "y1"), ("y1", "x1"), ("x1", "x1")))
DET = "(y1y1 * x1x1 - y1x1 * y1x1)"
LONG = f"(yy - (yy1 * x1x1 - yx1 * y1x1) / {DET} * yy1 - (yx1 * y1y1 - yy1 * y1x1) / {DET} * yx1)"


@add(
    "W70_granger",
    f"""WITH {RETURNS},
    l AS (SELECT symbol, ts, r, {slag('r')} AS r1 FROM r),
    j AS (SELECT a.symbol AS a, b.symbol AS b, b.r AS y, b.r1 AS y1, a.r1 AS x1 FROM l a JOIN l b ON a.ts = b.ts AND a.symbol <> b.symbol
        WHERE b.r1 IS NOT NULL AND a.r1 IS NOT NULL),
    s AS (SELECT a, b, count(*) AS n, {COVS} FROM j GROUP BY 1, 2)
    SELECT a, b, round(((yy - yy1 * yy1 / y1y1) - {LONG}) / ({LONG} / (n - 3)), 6) + 0.0 AS f FROM s""",
)
def w70(spark, d):
    return M.granger(returns(spark, d))


@add(
    "W72_refit_fill",
    f"""WITH {BARS},
    f AS (SELECT symbol, ts, close AS refit FROM bars WHERE hour(ts) = 0 AND day(ts) % 5 = 0)
    SELECT b.symbol, b.ts, round(refit, 6) + 0.0 AS refit FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.ts""",
)
def w72(spark, d):
    b = bars(spark, d)
    fits = b.filter((F.hour("ts") == 0) & (F.dayofmonth("ts") % 5 == 0)).select("symbol", "ts", c("close").alias("refit"))
    return J.asof(b.select("symbol", "ts"), fits, ["symbol"], ["refit"])


@add("W74_gate")
def w74(spark, d):
    """Blocks are weeks since the first row's day, so every later block is later in time."""
    x = I.rsi(I.atr(bars(spark, d), (6,))).dropna(subset=["rsi_14", "atr_6"])
    x = x.withColumns({"up": (F.lead("close").over(Window.partitionBy("symbol").orderBy("ts")) > c("close")).cast("double"), "day": F.datediff("ts", F.lit("1970-01-01"))}).dropna(subset=["up"])
    x = x.join(F.broadcast(x.agg(F.min("day").alias("first"))), F.lit(True)).withColumn("block", F.floor((c("day") - c("first")) / 7).cast("int"))
    return M.expanding_gate(x.select("symbol", "ts", "rsi_14", "atr_6", "up", "block"), ["rsi_14", "atr_6"], "up").select("symbol", "ts", "gate")


@add("W75_fused_sentiment", f"""WITH {TICKS},
    h AS (SELECT symbol, date_trunc('hour', ts) AS ts, avg(CASE WHEN id % 2 = 0 THEN mid END) AS news, avg(CASE WHEN id % 2 = 1 THEN mid END) AS social
        FROM ticks GROUP BY 1, 2),
    z AS (SELECT symbol, ts, coalesce(news, 0.0) AS news, coalesce(social, 0.0) AS social FROM h),
    e AS (SELECT symbol, ts, {s_ema('news', 12)} AS n, {s_ema('social', 12)} AS s FROM z) SELECT symbol, ts, round(0.6 * n + 0.4 * s, 6) + 0.0 AS fused, round(abs(n - s), 6) + 0.0 AS disagreement FROM e""")
def w75(spark, d):
    """Two sources by hour, each fading with time, their weighted sum and how far they part."""
    h = ticks(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(*[F.coalesce(F.avg(F.when(c("id") % 2 == k, c("mid"))), F.lit(0.0)).alias(n) for k, n in ((0, "news"), (1, "social"))])
    e = h.withColumns({"n": I.ema("news", 12), "s": I.ema("social", 12)})
    return e.select("symbol", "ts", (0.6 * c("n") + 0.4 * c("s")).alias("fused"), F.abs(c("n") - c("s")).alias("disagreement"))


@add(
    "W76_release_surprise",
    f"""WITH {TICKS},
    e AS (SELECT id, ts, mid, {roll('avg', 'mid', 20, 5, 1).replace('PARTITION BY symbol', 'PARTITION BY symbol').replace('ORDER BY ts', 'ORDER BY ts, id')} AS expected,
        {roll('stddev_samp', 'mid', 20, 5, 1).replace('ORDER BY ts', 'ORDER BY ts, id')} AS sd FROM ticks WHERE symbol = 'error')
    SELECT id, round((mid - expected) / (sd + 1e-9), 6) + 0.0 AS surprise FROM e""",
)
def w76(spark, d):
    before = Roll(20, 5, skip=1, order=("ts", "id"))
    e = ticks(spark, d).filter("symbol = 'error'")
    return e.select("id", ((c("mid") - before.avg(c("mid"))) / (before.std(c("mid")) + 1e-9)).alias("surprise"))


@add(
    "W77_stepped_psi",
    f"""WITH {TICKS}, t AS (SELECT symbol, mid, (dayofyear(ts) - 1) // 7 AS week FROM ticks),
    f AS (SELECT symbol, min(week) AS w0 FROM t GROUP BY 1),
    e AS (SELECT symbol, list_sort(list_distinct(quantile_cont(mid, [{", ".join(repr(i / 10) for i in range(1, 10))}]))) AS edges FROM t JOIN f USING (symbol) WHERE week = w0 GROUP BY 1),
    x AS (SELECT t.symbol, t.week, week > w0 AS live, len(list_filter(edges, lambda v: v < mid)) AS bin FROM t JOIN f USING (symbol) JOIN e USING (symbol)),
    n AS (SELECT symbol, week, live, bin, count(*) AS n FROM x GROUP BY ALL),
    g AS (SELECT DISTINCT w.symbol, w.week, b.bin FROM n w JOIN n b ON b.symbol = w.symbol WHERE w.live AND (b.week = w.week OR NOT b.live)),
    s AS (SELECT g.symbol, g.week, coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r FROM g
          LEFT JOIN n l ON l.symbol = g.symbol AND l.week = g.week AND l.bin = g.bin AND l.live
          LEFT JOIN n r ON r.symbol = g.symbol AND r.bin = g.bin AND NOT r.live),
    q AS (SELECT symbol, week, greatest(l / sum(l) OVER w, 1e-4) AS p, greatest(r / sum(r) OVER w, 1e-4) AS q FROM s WINDOW w AS (PARTITION BY symbol, week))
    SELECT symbol, week, round(sum((p - q) * ln(p / q)), 6) + 0.0 AS psi FROM q GROUP BY 1, 2""",
)
def w77(spark, d):
    """Each symbol's weeks against its first week."""
    t = ticks(spark, d).withColumn("week", F.floor((F.dayofyear("ts") - 1) / 7))
    first = t.groupBy("symbol").agg(F.min("week").alias("w0"))
    x = t.join(first, "symbol").withColumn("live", c("week") > c("w0"))
    weeks = x.filter("live").select("symbol", "week").distinct()
    both = x.filter("live").select("symbol", "week", "mid", "live").unionByName(x.filter("not live").drop("week").join(weeks, "symbol").select("symbol", "week", "mid", "live"))
    return S.psi(both, "mid", ["symbol", "week"], c("live"))


@add("A14_long_ema", f"WITH {BARS}, e AS (SELECT symbol, ts, {s_ema('close', 26)} AS ema FROM bars) SELECT symbol, ts, round(ema, 6) + 0.0 AS ema FROM e")
def a14(spark, d):
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    b = bars(spark, d).withColumn("row", nth).withColumn("bucket", F.floor(c("row") / 40))
    return M.long_ema(b, "close", 26)


@add(
    "A20_deltas",
    f"""WITH x AS (SELECT l_returnflag, l_quantity, (ln(l_extendedprice / (l_quantity * 1000)) + 0.04 / 2 * l_linenumber / 12.0) / (0.2 * sqrt(l_linenumber / 12.0)) AS z
        FROM lineitem)
    SELECT l_returnflag, round(sum(l_quantity * {CDF('z')}), 3) + 0.0 AS delta, round(sum(l_quantity), 3) + 0.0 AS notional
    FROM x GROUP BY 1""",
    3,
)
def a20(spark, d):
    delta = M.black_delta(c("l_extendedprice"), c("l_quantity") * 1000, F.lit(0.2), c("l_linenumber") / 12.0)
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(c("l_quantity") * delta).alias("delta"), F.sum("l_quantity").alias("notional"))


@add(
    "T7_T8_drift_report",
    f"""SELECT a.feature, a.psi, b.ks, b.p_value, b.wasserstein,
           CASE WHEN psi >= 0.3 THEN 'critical' WHEN psi >= 0.2 THEN 'high' WHEN psi >= 0.15 THEN 'moderate' WHEN psi >= 0.1 THEN 'low' ELSE 'none' END AS severity
    FROM ({STAT_SQL["T1_psi_quantile"]}) a JOIN ({STAT_SQL["T2_T3_ks_wasserstein"]}) b USING (feature)""",
)
def t7(spark, d):
    """Stability, distances and a severity for each feature."""
    x = melted(spark, d)
    out = S.psi(x, "x", ["feature"], c("live")).join(S.two_samples(x, "x", ["feature"], c("live")), "feature")
    level = F.when(c("psi") >= 0.3, "critical").when(c("psi") >= 0.2, "high").when(c("psi") >= 0.15, "moderate").when(c("psi") >= 0.1, "low").otherwise("none")
    return out.withColumn("severity", level)


@add("T11_separability")
def t11(spark, d):
    return M.separability(read(spark, d, "lineitem").select(*FEATURES, "l_shipdate"), FEATURES, c("l_shipdate") >= F.lit("1998-06-01").cast("timestamp"))


@add("F12_topics")
def f12(spark, d):
    return M.topics(read(spark, d, "documents").select("doc_id", "text"))


@add(
    "F1_F2_F3_F4_F5_F6_scalars",
    """SELECT event_id, round(log10(value + 1), 6) + 0.0 AS lg, round(1 / (1 + exp(-value / 100)), 6) + 0.0 AS logistic, greatest(least(CAST(floor(value) AS BIGINT), 400),
        50) AS clipped, isodow(ts) - 1 AS weekday, strftime(ts, '%Y-%m') AS month, upper(event_type[1:3]) AS tag, TRY_CAST(event_type AS DOUBLE) AS number
    FROM events""",
)
def f1(spark, d):
    v = c("value")
    return read(spark, d, "events").select("event_id", F.log10(v + 1).alias("lg"), (1 / (1 + F.exp(-v / 100))).alias("logistic"), F.greatest(F.least(F.floor(v), F.lit(400)), F.lit(50)).alias("clipped"), F.weekday("ts").cast("long").alias("weekday"), F.date_format("ts", "yyyy-MM").alias("month"), F.upper(F.substring("event_type", 1, 3)).alias("tag"), c("event_type").try_cast("double").alias("number"))


@add("F7_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f7(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@add(
    "G5_remediation",
    f"""WITH {BARS},
    q AS (SELECT symbol, quantile_cont(close, 0.05) AS a, quantile_cont(close, 0.95) AS b, quantile_cont(spread, 0.5) AS s
        FROM bars GROUP BY 1),
    f AS (SELECT symbol, ts, least(greatest(close, a), b) AS close, least(spread, 1.1 * s) AS spread, greatest(high, open, close) AS high, least(low, open, close) AS low
        FROM bars JOIN q USING (symbol) WHERE isodow(ts) < 6)
    SELECT symbol, ts, round(close, 6) + 0.0 AS close, round(spread, 6) + 0.0 AS spread, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low
    FROM f""",
)
def g5(spark, d):
    """Winsorised closes, capped spreads, repaired highs and lows, no weekends."""
    b = bars(spark, d)
    q = b.groupBy("symbol").agg(F.percentile("close", 0.05).alias("a"), F.percentile("close", 0.95).alias("b"), F.percentile("spread", 0.5).alias("s"))
    j = b.join(q, "symbol").filter(F.weekday("ts") < 5)
    return j.select("symbol", "ts", F.least(F.greatest("close", "a"), "b").alias("close"), F.least(c("spread"), 1.1 * c("s")).alias("spread"), F.greatest("high", "open", "close").alias("high"), F.least("low", "open", "close").alias("low"))


@add("G6_schema_drift", f"""WITH m AS (SELECT 'l_quantity' AS feature, l_quantity AS x, l_shipdate >= TIMESTAMP '1998-06-01' AS live FROM lineitem),
    e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges
        FROM m WHERE NOT live),
    b AS (SELECT len(list_filter(edges, lambda v: v < x)) AS bin, count(*) FILTER (NOT live) AS r, count(*) FILTER (live) AS l
        FROM m, e GROUP BY 1),
    s AS (SELECT greatest(l / sum(l) OVER (), 1e-4) AS p, greatest(r / sum(r) OVER (), 1e-4) AS q FROM b) SELECT 'l_quantity' AS "column", CASE WHEN sum((p - q) * ln(p / q)) > 0.1 THEN 'moved' ELSE 'stable' END AS change FROM s UNION ALL SELECT 'l_tax', 'removed' UNION ALL SELECT 'l_linenumber', 'type' UNION ALL SELECT 'tax_rate', 'added'""")
def g6(spark, d):
    """Columns that came, went or changed type against an expected schema, and whether a column that stayed has moved."""
    x = read(spark, d, "lineitem")
    now = x.withColumnRenamed("l_tax", "tax_rate").withColumn("l_linenumber", c("l_linenumber").cast("string"))
    moved = S.psi(x.select(F.lit("l_quantity").alias("column"), c("l_quantity").alias("x"), "l_shipdate"), "x", ["column"], c("l_shipdate") >= F.lit("1998-06-01").cast("timestamp"))
    return G.schema_drift(dict(x.dtypes), now).unionByName(moved.select("column", F.when(c("psi") > 0.1, "moved").otherwise("stable").alias("change")))


@add(
    "G7_report",
    """SELECT o_orderstatus AS gate, o_orderpriority AS part, count(*) AS rows, count(*) FILTER (o_totalprice > 400000) AS breaches, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def g7(spark, d):
    return read(spark, d, "orders").rollup(c("o_orderstatus").alias("gate"), c("o_orderpriority").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(c("o_totalprice") > 400000).alias("breaches"), F.grouping_id().alias("level"))


@add(
    "G13_lineage",
    """SELECT l_returnflag AS stage, l_linestatus AS state, count(*) AS records, min(l_shipdate) AS first, max(l_shipdate) AS last
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2""",
)
def g13(spark, d):
    rows = read(spark, d, "lineitem").filter(c("l_shipdate") >= F.lit("1996-01-01").cast("timestamp"))
    return rows.groupBy(c("l_returnflag").alias("stage"), c("l_linestatus").alias("state")).agg(F.count(F.lit(1)).alias("records"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@add(
    "G14_incremental",
    f"""WITH {BARS},
    r AS (SELECT symbol, ts, {ret()} AS r FROM bars),
    v AS (SELECT symbol, ts, {roll('stddev_samp', 'r', 20)} AS vol_20 FROM r)
    SELECT symbol, ts, round(vol_20, 6) + 0.0 AS vol_20 FROM v WHERE ts >= TIMESTAMP '2024-01-20'""",
)
def g14(spark, d):
    """New rows of a feature from the high-water mark on: only those and the warm-up before them are read."""
    mark, warm = F.lit("2024-01-20").cast("timestamp_ntz"), F.expr("INTERVAL 14 DAYS")
    tail = B.time_bars(ticks(spark, d).filter(c("ts") >= mark - warm))
    return I.volatility(tail, (20,)).filter(c("ts") >= mark).select("symbol", "ts", "vol_20")


#: Features by name: what they are made of, and how.
CATALOGUE = {"r": ([], log_return), "vol": (["r"], lambda: Roll(20).std(c("r"))), "mom": (["r"], lambda: Roll(20).sum(c("r"))), "sharpe": (["vol", "mom"], lambda: c("mom") / (c("vol") + 1e-9))}


def materialise(df, names):
    """Adds features in the order that their dependencies ask for."""
    done: list[str] = []

    def visit(n):
        for p in CATALOGUE[n][0]:
            visit(p)
        if n not in done:
            done.append(n)

    for n in names:
        visit(n)
    return layers(df, *[{n: CATALOGUE[n][1]()} for n in done])


@add(
    "G15_C18_features",
    f"""WITH {BARS},
    r AS (SELECT symbol, ts, {ret()} AS r FROM bars),
    v AS (SELECT symbol, ts, {roll('sum', 'r', 20)} / ({roll('stddev_samp', 'r', 20)} + 1e-9) AS sharpe FROM r)
    SELECT symbol, ts, round(sharpe, 6) + 0.0 AS sharpe FROM v""",
)
def g15(spark, d):
    return materialise(bars(spark, d), ["sharpe"]).select("symbol", "ts", "sharpe")


@add("C31_month_blocks", """WITH m AS (SELECT DISTINCT o_custkey AS k, date_trunc('month', o_orderdate) AS m FROM orders),
    g AS (SELECT k, unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS m
        FROM (SELECT DISTINCT k FROM m)),
    x AS (SELECT k, m FROM g ANTI JOIN (SELECT k, CAST(m AS TIMESTAMP) AS m FROM m) USING (k, m)),
    i AS (SELECT *, year(m) * 12 + month(m) - row_number() OVER (PARTITION BY k ORDER BY m) AS b FROM x) SELECT k, strftime(min(m), '%Y-%m') AS first, strftime(max(m), '%Y-%m') AS last, count(*) AS months FROM i GROUP BY k, b""")
def c31(spark, d):
    have = read(spark, d, "orders").select(c("o_custkey").alias("k"), F.trunc("o_orderdate", "month").alias("m")).distinct()
    span = have.agg(F.min("m").alias("a"), F.max("m").alias("b"))
    gone = have.select("k").distinct().join(F.broadcast(span)).select("k", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")).join(have, ["k", "m"], "left_anti")
    island = F.year("m") * 12 + F.month("m") - F.row_number().over(Window.partitionBy("k").orderBy("m"))
    month = lambda x: F.date_format(x, "yyyy-MM")
    return gone.withColumn("b", island).groupBy("k", "b").agg(month(F.min("m")).alias("first"), month(F.max("m")).alias("last"), F.count(F.lit(1)).alias("months")).drop("b")


@add(
    "C32_freshness",
    f"""WITH {TICKS}
    SELECT symbol, max(ts) AS last, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-20') > 14 AS stale FROM ticks
    GROUP BY 1""",
)
def c32(spark, d):
    return ticks(spark, d).groupBy("symbol").agg(F.max("ts").alias("last")).withColumn("stale", F.datediff(F.lit("2024-02-20").cast("date"), F.to_date("last")) > 14)


#: Ticks that the watermark has passed.
PASSED = "date_trunc('milliseconds', ts) < (SELECT max(date_trunc('milliseconds', ts)) FROM ticks) - INTERVAL 30 SECOND"


@add(
    "ST5_warm_up",
    f"""WITH {TICKS}, x AS (
        SELECT symbol, id, ts, round(avg(mid) OVER w, 6) + 0.0 AS sma, CAST(count(*) OVER w >= 20 AS DOUBLE) AS warm
        FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT symbol, id, sma, warm FROM x WHERE {PASSED}""",
)
def st5(spark, d):
    from tidemark.plans.store_queries import stateful

    return stateful(spark, d, jobs.sma_step(20), [], ["sma", "warm"])


@add(
    "ST8_online_lookahead",
    f"""WITH {TICKS}, p AS (
        SELECT symbol, id, ts, lag(mid) OVER w AS f, (mid - lag(mid) OVER w) / lag(mid) OVER w AS r, row_number() OVER w - 1 AS n
        FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, id)),
    k AS (
        SELECT *, corr(f, r) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS now
        FROM p WHERE n > 0),
    h AS (
        SELECT symbol, n, now, count(*) OVER b AS seen, avg(now) OVER b AS m, stddev_pop(now) OVER b AS dev
        FROM k WHERE n % 100 = 0 AND n >= 200 WINDOW b AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT p.symbol, p.id, round(coalesce(h.now, 0.0), 6) + 0.0 AS corr,
           CASE WHEN h.seen >= 10 AND abs(h.now) - abs(h.m) > 4 * (h.dev + 1e-10) AND abs(h.now) > 0.7 THEN 1.0 ELSE 0.0 END AS alert
    FROM p LEFT JOIN h ON h.symbol = p.symbol AND h.n = p.n WHERE {PASSED.replace("ts)", "p.ts)", 1)}""",
)
def st8(spark, d):
    from tidemark.plans.store_queries import stateful

    return stateful(spark, d, jobs.lookahead_step(), [], ["corr", "alert"])


@add(
    "ST13_trade_monitor",
    """WITH t AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_shipdate, l_discount - 0.05 AS r, l_extendedprice, l_partkey
        FROM lineitem)
    SELECT l_returnflag, l_orderkey, l_linenumber, round(CASE WHEN count(r) OVER w >= 50 THEN avg(r) OVER w / (stddev_samp(r) OVER w + 1e-9) END,
        6) + 0.0 AS sharpe, round(CASE WHEN count(r) OVER w >= 50 THEN avg(CAST(r > 0 AS INT)) OVER w END, 6) + 0.0 AS win_rate
    FROM t WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
)
def st13(spark, d):
    """The last 50 trades of a flag, dealt into buckets of rows with the 49 before them as halo."""
    order = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    x = read(spark, d, "lineitem").select(F.struct("l_returnflag").alias("symbol"), c("l_shipdate").alias("ts"), *order[1:], (c("l_discount") - 0.05).alias("r"))
    roll50 = Roll(50, key=("symbol", "bucket"), order=order)
    out = B.in_buckets(x, 49, order=order).withColumns({"sharpe": roll50.avg(c("r")) / (roll50.std(c("r")) + 1e-9), "win_rate": roll50.avg((c("r") > 0).cast("int"))})
    return out.filter(~c("halo")).select("symbol.l_returnflag", "l_orderkey", "l_linenumber", "sharpe", "win_rate")


#: Bars of five minutes, enough for frames of a day and more.
SHORT_BARS = BARS.replace("INTERVAL '6 hours'", "INTERVAL '5 minutes'")


@add(
    "W13_full_window",
    f"""WITH {SHORT_BARS}, r AS (SELECT symbol, ts, {ret()} AS r FROM bars),
    v AS (SELECT *, {roll('q0.05', 'r', 1440, 60, 1)} AS a, {roll('q0.01', 'r', 1440, 60, 1)} AS b FROM r)
    SELECT symbol, ts, round(a, 6) + 0.0 AS var_95, round(b, 6) + 0.0 AS var_99, coalesce(CAST(r < a AS INT), 0) AS breach_95, coalesce(CAST(r < b AS INT), 0) AS breach_99 FROM v""",
)
def w13_full(spark, d):
    """Historical value at risk over the last 1,440 bars."""
    r = B.time_bars(ticks(spark, d), "5 minutes").select("symbol", "ts", log_return().alias("r"))
    return order_stats.value_at_risk(r, "r").select("symbol", "ts", "var_95", "var_99", "breach_95", "breach_99")


@add("W37_full_window", f"WITH {SHORT_BARS}, v AS (SELECT symbol, ts, spread / ({roll('q0.5', 'spread', 120)} + 1e-9) AS v FROM bars) SELECT symbol, ts, round(v, 6) + 0.0 AS liquidity_vacuum FROM v")
def w37_full(spark, d):
    """Spread over its median of the last 120 bars."""
    return order_stats.vacuum(B.time_bars(ticks(spark, d), "5 minutes").select("symbol", "ts", "spread")).select("symbol", "ts", "liquidity_vacuum")
