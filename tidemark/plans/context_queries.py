"""Queries for indicators over more than a symbol's own bars, functions and resampling, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.frames import Roll, lag, layers, rounded
from tidemark.operators import bars as B
from tidemark.operators import context as K
from tidemark.operators import indicators as I
from tidemark.plans.label_queries import ATR
from tidemark.plans.sql import BARS, TICKS, corr, cov, nearest, query, ret, roll
from tidemark.plans.sql import lag as slag
from tidemark.plans.stat_queries import RETURNS, returns
from tidemark.sources.tables import read, ticks

QUERIES, SQL = {}, {}


def c(name):
    return F.col(name)


R = lambda *cols: ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in cols)


def add(name, sql, digits=6):
    def put(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            SQL[name] = sql
        return f

    return put


def bars(spark, d):
    return B.time_bars(ticks(spark, d))




@add("W6_level_imbalance", "SELECT vec_id, " + ", ".join(f"round((e[{i}] - e[{i + 5}]) / (e[{i}] + e[{i + 5}] + 1e-9), 6) + 0.0 AS obi_l{i}" for i in range(1, 6)) + ", round((e[1]+e[2]+e[3]+e[4]+e[5] - (e[6]+e[7]+e[8]+e[9]+e[10])) / (e[1]+e[2]+e[3]+e[4]+e[5] + (e[6]+e[7]+e[8]+e[9]+e[10]) + 1e-9), 6) + 0.0 AS obi_aggregate FROM (SELECT vec_id, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) AS e FROM embeddings)")
def w6(spark, d):
    e = read(spark, d, "embeddings")
    size = lambda i: F.element_at("embedding", i).cast("double") * F.element_at("embedding", i).cast("double")
    e = e.select("vec_id", *[size(i).alias(f"b{i}") for i in range(1, 6)], *[size(i + 5).alias(f"a{i}") for i in range(1, 6)])
    return K.products(I.level_imbalance(e, [f"b{i}" for i in range(1, 6)], [f"a{i}" for i in range(1, 6)]), []).select("vec_id", *[f"obi_l{i}" for i in range(1, 6)], "obi_aggregate")


@add(
    "W7_depth_two",
    f"""WITH {BARS},
    x AS (SELECT *, (bid_close * n - ask_close * volume / 50) / (n + volume / 50 + 1e-9) + ((bid_close - 0.01) * n - (ask_close + 0.01) * volume / 50) / (n + volume / 50 + 1e-9) AS i
        FROM bars),
    y AS (SELECT symbol, ts, {roll('avg', 'i', 20)} AS ofi_l2 FROM x)
    SELECT symbol, ts, {R('ofi_l2')} FROM y""",
)
def w7(spark, d):
    bv, av = c("n"), c("volume") / 50
    level = lambda off: ((c("bid_close") - off) * bv - (c("ask_close") + off) * av) / (bv + av + 1e-9)
    return layers(bars(spark, d), {"i": level(0.0) + level(0.01)}, {"ofi_l2": Roll(20).avg(c("i"))}).select("symbol", "ts", "ofi_l2")


@add(
    "W14_position_limit",
    f"""WITH {ATR}
    SELECT symbol, ts, round(least(0.05 / (atr_6 / close + 1e-9), 1.0), 6) + 0.0 AS position_limit, CASE WHEN symbol = 'view' THEN 7.0 ELSE 10.0 END AS pip_value
    FROM x""",
)
def w14(spark, d):
    b = I.atr(bars(spark, d), (6,))
    limit = F.when(c("atr_6").isNotNull(), F.least(0.05 / (c("atr_6") / c("close") + 1e-9), F.lit(1.0))).otherwise(F.lit(1.0))
    return b.select("symbol", "ts", limit.alias("position_limit"), F.when(c("symbol") == "view", 7.0).otherwise(10.0).alias("pip_value"))


PAIRS = [("rsi_14", "vol_20", "rsi_x_vol"), ("rsi_14", "vol_ok", "rsi_gated"), ("vol_20", "vol_ok", "vol_gated")]


@add(
    "W33_W34_products",
    f"""WITH {ATR},
    r AS (SELECT *, {ret()} AS r, close - pc AS d FROM x),
    g AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS l
        FROM r),
    m AS (SELECT *, 100 - 100 / (1 + {roll('avg', 'g', 14)} / ({roll('avg', 'l', 14)} + 1e-9)) AS rsi_14, {roll('stddev_samp', 'r', 20)} AS vol_20,
        CAST(atr_6 <= 3 * {roll('avg', 'atr_6', 60)} AS DOUBLE) AS vol_ok FROM g),
    p AS (SELECT symbol, ts, rsi_14 * vol_20 AS rsi_x_vol, rsi_14 * vol_ok AS rsi_gated, vol_20 * vol_ok AS vol_gated
        FROM m)
    SELECT symbol, ts, {R('rsi_x_vol', 'rsi_gated', 'vol_gated')} FROM p""",
)
def w33(spark, d):
    b = I.volatility_filter(I.volatility(I.rsi(bars(spark, d)), (20,)))
    return K.products(b, PAIRS).select("symbol", "ts", *[p[2] for p in PAIRS])


HTF = ["ret", "rsi", "atr", "trend_slope", "vwap_distance", "vol_regime"]


@add("W41_higher_frame", f"""WITH {BARS},
    u AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY AS t, first(open
        ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
        FROM bars GROUP BY ALL),
    v AS (SELECT symbol, t AS ts, * EXCLUDE (symbol, t) FROM u),
    a AS (SELECT *, {slag('close')} AS pc FROM v),
    b AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, close - pc AS d, CASE WHEN volume = 0 THEN 1.0 ELSE volume END AS v1
        FROM a),
    e AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS l, {roll('avg', 'tr', 14, 3)} AS at0
        FROM b),
    e2 AS (SELECT *, {roll('sum', '((high + low + close) / 3 * v1)', 20, 3)} / ({roll('sum', 'v1', 20, 3)} + 1e-9) AS vw
        FROM e),
    f AS (SELECT symbol, ts, ln(close) - ln(pc) AS ret, 100 - 100 / (1 + {roll('avg', 'g', 14, 5)} / ({roll('avg', 'l', 14, 5)} + 1e-9)) AS rsi,
        at0 AS atr, (close - {slag('close', 3)}) / (at0 + 1e-9) AS trend_slope, (close - vw) / (at0 + 1e-9) AS vwap_distance, at0 / ({roll('q0.5', 'at0', 24, 5)} + 1e-9) AS vol_regime
        FROM e2),
    h AS (SELECT symbol, ts, {', '.join(f'coalesce({slag(n)}, 0.0) AS htf_{n}' for n in HTF)} FROM f)
    SELECT b.symbol, b.ts, {', '.join(f'round(coalesce(htf_{n}, 0.0), 6) + 0.0 AS htf_{n}' for n in HTF)} FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.ts""")
def w41(spark, d):
    return K.higher_frame(bars(spark, d), "1 day")


@add(
    "W42_vol_state",
    f"""WITH {BARS},
    a AS (SELECT *, {ret()} AS r FROM bars),
    v AS (SELECT *, {roll('stddev_samp', 'r', 20)} AS v, abs({roll('sum', 'r', 20)}) / ({roll('sum', 'abs(r)', 20)} + 1e-9) AS trend_quality
        FROM a),
    q AS (SELECT *, {nearest('v', 0.25, 30)} AS lo, {nearest('v', 0.75, 30)} AS hi FROM v)
    SELECT symbol, ts, CASE WHEN hi IS NULL THEN NULL WHEN v > hi THEN 2 WHEN v < lo THEN 0 ELSE 1 END AS vol_state, {R('trend_quality')}
    FROM q""",
)
def w42(spark, d):
    return K.vol_state(bars(spark, d), 30).select("symbol", "ts", "vol_state", "trend_quality")


@add(
    "W44_latency",
    f"""WITH {ATR},
    m AS (SELECT *, {roll('q0.5', 'atr_6', 60)} AS med FROM x)
    SELECT symbol, ts, round(CASE WHEN med IS NOT NULL THEN least(greatest(atr_6 / (med + 1e-9) - 1, 0.0), 5.0) END, 6) + 0.0 AS latency
    FROM m""",
)
def w44(spark, d):
    b = I.atr(bars(spark, d), (6,)).withColumn("med", Roll(60).quantile(c("atr_6"), 0.5))
    x = F.least(F.greatest(c("atr_6") / (c("med") + 1e-9) - 1, F.lit(0.0)), F.lit(5.0))
    return b.select("symbol", "ts", F.when(c("med").isNotNull(), x).alias("latency"))


@add(
    "W47_cross_asset",
    f"""WITH {RETURNS},
    j AS (SELECT a.symbol, a.ts, a.r, b.r AS x FROM r a JOIN r b ON a.ts = b.ts AND b.symbol = 'view' AND a.symbol <> 'view'),
    k AS (SELECT symbol, ts, x, {slag('x', 1)} AS x_lag_1, {slag('x', 5)} AS x_lag_5, {corr('r', 'x', 30)} AS corr, {cov('r', 'x', 30)} / ({roll('stddev_samp', 'x', 30)} ** 2 + 1e-12) AS beta
        FROM j)
    SELECT symbol, ts, {R('x', 'x_lag_1', 'x_lag_5', 'corr', 'beta')} FROM k""",
)
def w47(spark, d):
    return K.cross_asset(returns(spark, d), "view", 30).select("symbol", "ts", "x", "x_lag_1", "x_lag_5", "corr", "beta")


@add("W48_W49_spreads", f"""WITH {BARS}, w AS (SELECT 'all' AS symbol, ts, max(close) FILTER (symbol = 'view') AS a, max(close) FILTER (symbol = 'click') AS b FROM bars GROUP BY ts), s AS (SELECT *, a - b AS spread FROM w), m AS (SELECT ts, spread, spread - {slag('spread', 5)} AS mom_5, spread - {slag('spread', 20)} AS mom_20, {roll('stddev_samp', 'spread', 20)} AS vol_20 FROM s) SELECT ts, {R('spread', 'mom_5', 'mom_20', 'vol_20')} FROM m""")
def w48(spark, d):
    """A spread of two series by time, its momentum and volatility; one row for each time, so the panel is narrow."""
    w = bars(spark, d).groupBy("ts").agg(F.max(F.when(c("symbol") == "view", c("close"))).alias("a"), F.max(F.when(c("symbol") == "click", c("close"))).alias("b")).withColumns({"symbol": F.lit("all"), "spread": c("a") - c("b")})
    return w.withColumns({"mom_5": c("spread") - lag("spread", 5), "mom_20": c("spread") - lag("spread", 20), "vol_20": Roll(20).std(c("spread"))}).select("ts", "spread", "mom_5", "mom_20", "vol_20")


@add(
    "W50_carry",
    f"""WITH {BARS},
    x AS (SELECT *, ln(ask_close / close) AS carry FROM bars),
    y AS (SELECT symbol, ts, {roll('avg', 'carry', 30)} AS carry_spot_forward, ask_close - bid_close AS slope FROM x)
    SELECT symbol, ts, {R('carry_spot_forward', 'slope')} FROM y""",
)
def w50(spark, d):
    return layers(bars(spark, d), {"x": F.log(c("ask_close") / c("close"))}, {"carry_spot_forward": Roll(30).avg(c("x")), "slope": c("ask_close") - c("bid_close")}).select("symbol", "ts", "carry_spot_forward", "slope")


@add("W51_W52_positioning", f"""WITH w AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) + INTERVAL 11 DAY AS ts, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) AS net
        FROM orders GROUP BY ALL),
    z AS (SELECT *, net - {slag('net', 4)} AS mom_4w, (net - {roll('avg', 'net', 52)}) / ({roll('stddev_samp', 'net', 52)} + 1e-9) AS z_52w FROM w), o AS (SELECT o_orderkey, o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders)
    SELECT o.o_orderkey, round(coalesce(net, 0.0), 6) + 0.0 AS net, round(coalesce(mom_4w, 0.0), 6) + 0.0 AS mom_4w, round(coalesce(z_52w, 0.0), 6) + 0.0 AS z_52w, CASE WHEN z_52w > 2 THEN 1 WHEN z_52w < -2 THEN -1 ELSE 0 END AS extreme FROM o ASOF LEFT JOIN z ON o.symbol = z.symbol AND o.ts >= z.ts""", 5)
def w51(spark, d):
    o = read(spark, d, "orders")
    net = F.sum(F.when(c("o_orderstatus") == "F", -c("o_totalprice")).otherwise(c("o_totalprice")))
    week = (F.date_trunc("week", "o_orderdate") + F.expr("INTERVAL 11 DAYS")).cast("timestamp")
    w = o.groupBy(c("o_orderpriority").alias("symbol"), week.alias("ts")).agg(net.alias("net"))
    rows = o.select("o_orderkey", c("o_orderpriority").alias("symbol"), c("o_orderdate").cast("timestamp").alias("ts"))
    return K.positioning(w, rows, ["symbol"]).select("o_orderkey", "net", "mom_4w", "z_52w", "extreme")


SQL["W51_W52_positioning"] = SQL["W51_W52_positioning"].replace(", 6) + 0.0", ", 5) + 0.0")


@add("W53_decay", f"""WITH {BARS},
    a AS (SELECT symbol, ts, CASE WHEN close > 400 THEN close - 400 ELSE 0.0 END AS x FROM bars),
    b AS (SELECT *, last_value(CASE WHEN x <> 0 THEN ts END IGNORE NULLS) OVER w AS t, last_value(CASE WHEN x <> 0 THEN x END IGNORE NULLS) OVER w AS v
        FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))
    SELECT symbol, ts, round(coalesce(v * exp(-0.05 * epoch(ts - t) / 3600), 0.0), 6) + 0.0 AS decayed FROM b""")
def w53(spark, d):
    b = bars(spark, d).withColumn("x", F.when(c("close") > 400, c("close") - 400).otherwise(0.0))
    return K.decayed(b, "x", 0.05).select("symbol", "ts", "decayed")


@add("W54_buzz", f"WITH {BARS}, y AS (SELECT symbol, ts, coalesce({roll('sum', 'n', 5)}, 0.0) AS buzz FROM bars) SELECT symbol, ts, {R('buzz')} FROM y")
def w54(spark, d):
    return bars(spark, d).select("symbol", "ts", F.coalesce(Roll(5).sum(c("n")).cast("double"), F.lit(0.0)).alias("buzz"))


@add(
    "W55_relative",
    f"""WITH {RETURNS},
    o AS (SELECT *, {roll('sum', 'r', 20)} AS mom, {roll('stddev_samp', 'r', 20)} AS vol FROM r),
    x AS (SELECT symbol, ts, mom - avg(mom) OVER t AS rel_momentum, vol / (sum(vol) OVER t + 1e-9) AS vol_share, stddev_samp(r) OVER t AS dispersion
        FROM o WINDOW t AS (PARTITION BY ts))
    SELECT symbol, ts, {R('rel_momentum', 'vol_share', 'dispersion')} FROM x""",
)
def w55(spark, d):
    return K.relative(returns(spark, d)).select("symbol", "ts", "rel_momentum", "vol_share", "dispersion")


@add("W57_gap_atr", f"""WITH {ATR},
    g AS (SELECT symbol, CAST(ts AS DATE) AS day, last(mid ORDER BY ts, id) FILTER (hour(ts) < 8) AS asia, first(mid
        ORDER BY ts, id) FILTER (hour(ts) BETWEEN 8 AND 15) AS london FROM ticks GROUP BY ALL)
    SELECT x.symbol, x.ts, round(coalesce(CASE WHEN hour(x.ts) = 6 THEN (london - asia) / (atr_6 + 1e-9) END, 0.0), 6) + 0.0 AS gap_atr FROM x LEFT JOIN g ON x.symbol = g.symbol AND CAST(x.ts AS DATE) = g.day""")
def w57(spark, d):
    h, at = F.hour("ts"), F.struct("ts", "id")
    asia, london = h < 8, (h >= 8) & (h < 16)
    t = ticks(spark, d)
    day = t.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by(F.when(asia, c("mid")), F.when(asia, at)).alias("a"), F.min_by(F.when(london, c("mid")), F.when(london, at)).alias("l"))
    b = I.atr(B.time_bars(t), (6,)).withColumn("day", F.to_date("ts")).join(day, ["symbol", "day"], "left")
    return b.select("symbol", "ts", F.coalesce(F.when(F.hour("ts") == 6, (c("l") - c("a")) / (c("atr_6") + 1e-9)), F.lit(0.0)).alias("gap_atr"))


PC = "p AS (SELECT a.symbol || '/' || b.symbol AS symbol, a.ts, a.r AS x, b.r AS y FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol)"
KK = f"(CASE WHEN count(x) {{w}} >= 10 THEN (sum(x * y) {{w}} - sum(x) {{w}} * sum(y) {{w}} / count(x) {{w}}) / (count(x) {{w}} - 1) / (stddev_samp(x) {{w}} * stddev_samp(y) {{w}} + 1e-12) END)".replace("{w}", "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
ZW = "OVER (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@add("W60_pair_correlations", f"""WITH {RETURNS}, {PC},
    k AS (SELECT ts, {KK} AS k FROM p),
    g AS (SELECT ts, avg(k) AS corr_avg, coalesce(stddev_samp(k), 0.0) AS corr_dispersion FROM k GROUP BY 1),
    e AS (SELECT *, (1 + 4 * least(abs(corr_avg), 0.99)) / greatest(1 - least(abs(corr_avg), 0.99), 1e-6) AS corr_eigenratio
        FROM g),
    z AS (SELECT *, (corr_avg - CASE WHEN count(corr_avg) {ZW} >= 30 THEN avg(corr_avg) {ZW} END) / (CASE WHEN count(corr_avg) {ZW} >= 30 THEN stddev_samp(corr_avg) {ZW} END + 1e-9) AS corr_zscore FROM e)
    SELECT ts, {R('corr_avg', 'corr_dispersion', 'corr_zscore')}, CAST(abs(corr_zscore) > 2 AS INT) AS corr_break, round(CASE WHEN corr_avg IS NOT NULL THEN corr_eigenratio END, 6) + 0.0 AS corr_eigenratio FROM z""")
def w60(spark, d):
    out = K.pair_correlations(returns(spark, d), 20, 30)
    return out.withColumn("corr_eigenratio", F.when(c("corr_avg").isNotNull(), c("corr_eigenratio")))


@add(
    "W62_implied_proxy",
    f"""WITH {RETURNS},
    x AS (SELECT symbol, ts, {roll('stddev_samp', '(CASE WHEN r > 0 THEN r END)', 20, 5)} AS up_vol, {roll('stddev_samp', '(CASE WHEN r < 0 THEN r END)', 20, 5)} AS down_vol,
        {roll('stddev_samp', 'r', 5)} / ({roll('stddev_samp', 'r', 20)} + 1e-9) AS term FROM r)
    SELECT symbol, ts, {R('up_vol', 'down_vol', 'term')}, round(up_vol - down_vol, 6) + 0.0 AS risk_reversal FROM x""",
)
def w62(spark, d):
    r = Roll(20, 5)
    x = returns(spark, d).withColumns({"up_vol": r.std(F.when(c("r") > 0, c("r"))), "down_vol": r.std(F.when(c("r") < 0, c("r"))), "term": Roll(5).std(c("r")) / (Roll(20).std(c("r")) + 1e-9)})
    return x.select("symbol", "ts", "up_vol", "down_vol", "term", (c("up_vol") - c("down_vol")).alias("risk_reversal"))


@add("W63_depth", """WITH e AS (SELECT vec_id, list_transform(embedding[1:32], lambda v: abs(CAST(v AS DOUBLE))) AS b, list_transform(embedding[33:64], lambda v: abs(CAST(v AS DOUBLE))) AS a
        FROM embeddings),
    s AS (SELECT *, list_sum(b) AS bid_depth, list_sum(a) AS ask_depth FROM e)
    SELECT vec_id, round(bid_depth, 6) + 0.0 AS bid_depth, round(ask_depth, 6) + 0.0 AS ask_depth, round((bid_depth - ask_depth) / (bid_depth + ask_depth + 1e-9), 6) + 0.0 AS imbalance, CAST(len(list_filter(b, lambda v: v > 3 * bid_depth / 32)) > 0 AS INT) AS bid_wall, CAST(len(list_filter(a, lambda v: v > 3 * ask_depth / 32)) > 0 AS INT) AS ask_wall, round(a[1] / (a[1] + b[1] + 1e-9), 6) + 0.0 AS micro_weight FROM s""")
def w63(spark, d):
    part = lambda a: F.transform(F.slice("embedding", a, 32), lambda v: F.abs(v.cast("double")))
    e = read(spark, d, "embeddings").select("vec_id", part(1).alias("b"), part(33).alias("a"))
    return K.depth(e, "b", "a", 32).drop("a", "b")


@add("W64_hurst", f"""WITH {RETURNS},
    w AS (SELECT symbol, ts, list(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS w, row_number() OVER (PARTITION BY symbol
        ORDER BY ts) AS i FROM r),
    u AS (SELECT symbol, ts, w, unnest([8, 16, 32]) AS k FROM w WHERE len(w) = 64 AND i % 8 = 0),
    h AS (SELECT symbol, ts, k, w, unnest(range(64 // k)) AS j FROM u),
    v AS (SELECT symbol, ts, k, w[j * k + 1:j * k + k] AS v FROM h),
    s AS (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS sd FROM v),
    q AS (SELECT symbol, ts, k, sd, list_transform(range(1, k + 1), lambda n: list_sum(v[1:n]) - n * m) AS walk
        FROM s),
    g AS (SELECT symbol, ts, k, avg((list_max(walk) - list_min(walk)) / sd) AS rs FROM q WHERE sd > 1e-12 GROUP BY ALL) SELECT symbol, ts, round(regr_slope(ln(rs), ln(k)), 6) + 0.0 AS hurst FROM g GROUP BY ALL""")
def w64(spark, d):
    return K.hurst(returns(spark, d), "r")


@add(
    "W71_lead_lag",
    f"""WITH {RETURNS},
    a AS (SELECT symbol, ts, {slag('r', 1)} AS x1, {slag('r', 2)} AS x2, {slag('r', 3)} AS x3 FROM r),
    j AS (SELECT a.symbol AS a, b.symbol AS b, corr(x1, b.r) AS k1, corr(x2, b.r) AS k2, corr(x3, b.r) AS k3 FROM a
        JOIN r b ON a.ts = b.ts AND a.symbol <> b.symbol GROUP BY 1, 2)
    SELECT a, b, CASE WHEN abs(k1) >= abs(k2) AND abs(k1) >= abs(k3) THEN 1 WHEN abs(k2) >= abs(k3) THEN 2 ELSE 3 END AS lag, round(CASE WHEN abs(k1) >= abs(k2) AND abs(k1) >= abs(k3) THEN k1 WHEN abs(k2) >= abs(k3) THEN k2 ELSE k3 END,
        6) + 0.0 AS corr FROM j""",
)
def w71(spark, d):
    return K.lead_lag(returns(spark, d))


QUANTILE = lambda x, q: roll(f"q{q}", x, 60, 20, 1)


@add(
    "W73_no_trade",
    query(
        [
            {"pc": slag("close")},
            {"tr": "greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low))", "u": f"high - {slag('high')}", "d": f"{slag('low')} - low"},
            {"atr_6": roll("avg", "tr", 6), "pu": "CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END", "pd": "CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END", "st": roll("sum", "tr", 14, 5)},
            {"pi": f"100 * {roll('sum', 'pu', 14, 5)} / (st + 1e-9)", "mi": f"100 * {roll('sum', 'pd', 14, 5)} / (st + 1e-9)"},
            {"dx": "100 * abs(pi - mi) / (pi + mi + 1e-9)"},
            {"adx_14": roll("avg", "dx", 14, 5)},
            {"no_trade": f"(coalesce(CAST(atr_6 > {QUANTILE('atr_6', 0.9)} AS INT), 0) + coalesce(CAST(spread > {QUANTILE('spread', 0.9)} AS INT), 0) + coalesce(CAST(adx_14 < {QUANTILE('adx_14', 0.1)} AS INT), 0)) / 3.0"},
        ],
        ["no_trade"],
    ),
)
def w73(spark, d):
    return K.no_trade(I.directional_regime(I.atr(bars(spark, d), (6,)))).select("symbol", "ts", "no_trade")


@add(
    "W78_ranking",
    f"""WITH {TICKS}
    SELECT id, CAST(ntile(10) OVER (PARTITION BY symbol ORDER BY mid, id) AS INT) AS decile, round(percent_rank() OVER (PARTITION BY symbol
        ORDER BY mid), 6) + 0.0 AS pct FROM ticks""",
)
def w78(spark, d):
    w = Window.partitionBy("symbol")
    return ticks(spark, d).select("id", F.ntile(10).over(w.orderBy("mid", "id")).alias("decile"), F.percent_rank().over(w.orderBy("mid")).alias("pct"))


# functions over text, arrays and sizes
#: Headlines that the rows of orders are given in turn.
HEADLINES = (
    "Fed raises interest rates as inflation rises", "ECB on hold, outlook weak", "EUR/USD jumps on strong payroll jobs", "Gold drops as dollar gains",
    "Unemployment falls, recovery gains strength", "BOJ dovish: stimulus and quantitative easing", "GBPJPY slides on recession fears",
    "Rate cuts boost growth, GDP beats forecasts", "FOMC minutes hawkish; taper and tightening ahead", "Bank of England holds rates, no change in CPI",
    "Orders misses expectations, sanctions weigh on trade", "Quiet session, nothing moved", "AUD/JPY and usd/chf firm; SNB lowered rates",
)


def headlines(spark, d):
    k = c("o_orderkey") % len(HEADLINES)
    text = F.concat(F.array(*map(F.lit, HEADLINES))[k.cast("int")], F.lit(" "), c("o_orderpriority"))
    return read(spark, d, "orders").select(c("o_orderkey").alias("id"), text.alias("text"))


def quoted(x):
    return "'" + x.replace("'", "''") + "'"


NEWS = f"""news AS (SELECT o_orderkey AS id, ([{", ".join(map(quoted, HEADLINES))}])[o_orderkey % {len(HEADLINES)} + 1] || ' ' || o_orderpriority AS text FROM orders)"""


def counted(patterns, any_case=True):
    return "(" + " + ".join(f"len(regexp_extract_all(text, {quoted(p)}, 0{", 'i'" if any_case else ""}))" for p in patterns) + ")"


@add(
    "F9_tone",
    f"""WITH {NEWS},
    h AS (SELECT id, {counted(X.UP)} AS b, {counted(X.DOWN)} AS s FROM news)
    SELECT id, round((b - s) / (b + s + 2.0), 6) + 0.0 AS tone FROM h""",
)
def f9(spark, d):
    return headlines(spark, d).select("id", X.tone(c("text")).alias("tone"))


PAIR_HITS = [counted(p, i == 0) for i, p in enumerate(X.pair_patterns())]
BANK_HITS = counted([rf"\b{b}\b" for b in X.BANKS])


@add(
    "F10_category_counts",
    f"WITH {NEWS} SELECT id, "
    + ", ".join(f"CAST({counted(v)} AS INT) AS {k}" for k, v in X.CATEGORIES.items())
    + f", CAST({PAIR_HITS[0]} + {PAIR_HITS[1]} AS INT) AS pair_mentions, CAST({BANK_HITS} AS INT) AS cb_mentions FROM news",
)
def f10(spark, d):
    all_counts = X.category_counts(c("text")) | X.mention_counts(c("text"))
    return headlines(spark, d).select("id", *[v.alias(k) for k, v in all_counts.items()])


@add("F11_high_impact", f"WITH {NEWS} SELECT id, " + " OR ".join(f"contains(lower(text), {quoted(k)})" for k in X.HIGH_IMPACT) + " AS high FROM news")
def f11(spark, d):
    return headlines(spark, d).select("id", X.high_impact(c("text")).alias("high"))


@add(
    "F13_sizing",
    f"""WITH {RETURNS},
    x AS (SELECT symbol, ts, least(0.10 / ({roll('stddev_samp', 'r', 20)} * sqrt(1460) + 1e-9), 2.0) AS vol_scalar, {roll('stddev_samp', 'r', 20)} AS s
        FROM r)
    SELECT symbol, ts, {R('vol_scalar')} FROM x WHERE s IS NOT NULL""",
)
def f13(spark, d):
    x = returns(spark, d).withColumn("s", Roll(20).std(c("r"))).filter("s is not null")
    return x.select("symbol", "ts", F.least(0.10 / (c("s") * F.sqrt(F.lit(1460.0)) + 1e-9), F.lit(2.0)).alias("vol_scalar"))


@add(
    "F13_kelly",
    """WITH g AS (SELECT l_returnflag, avg(CAST(l_discount > 0.05 AS INT)) AS p, avg(l_discount - 0.05) FILTER (l_discount > 0.05) AS w, -avg(l_discount - 0.05) FILTER (l_discount < 0.05) AS l
        FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(p - (1 - p) / (w / l), 6) + 0.0 AS kelly FROM g""",
)
def f13b(spark, d):
    x = c("l_discount") - 0.05
    g = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg((c("l_discount") > 0.05).cast("int")).alias("p"), F.avg(F.when(c("l_discount") > 0.05, x)).alias("w"), (-F.avg(F.when(c("l_discount") < 0.05, x))).alias("l"))
    return g.select("l_returnflag", (c("p") - (1 - c("p")) / (c("w") / c("l"))).alias("kelly"))


@add(
    "F14_entropy",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS z FROM embeddings),
    p AS (SELECT vec_id, list_transform(z, lambda v: v / list_sum(z)) AS p FROM s)
    SELECT vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))), 6) + 0.0 AS entropy, CAST(floor(list_max(p) * 10) AS BIGINT) AS bin
    FROM p""",
)
def f14(spark, d):
    z = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.exp(v.cast("double"))).alias("z"))
    p = z.select("vec_id", F.transform("z", lambda v: v / F.aggregate("z", F.lit(0.0), lambda a, x: a + x)).alias("p"))
    return p.select("vec_id", (-F.aggregate("p", F.lit(0.0), lambda a, v: a + v * F.log(v))).alias("entropy"), F.floor(F.array_max("p") * 10).alias("bin"))


@add("F8_row_hashes", "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)) AS h FROM orders")
def f8(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", c("o_orderkey").cast("string"), c("o_custkey").cast("string"), "o_orderstatus"), 256).alias("h"))


@add(
    "F15_projection",
    """SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) / 8)),
        6) + 0.0 AS p0, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (CASE WHEN i % 4 < 2 THEN 1 ELSE -1 END) / 8)),
        6) + 0.0 AS p1 FROM embeddings""",
)
def f15(spark, d):
    """A fixed matrix of signs (rows of a Hadamard matrix), by one pass over the array."""
    dot = lambda sign: F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * F.when(sign(i + 1), 1).otherwise(-1) / 8), F.lit(0.0), lambda a, x: a + x)
    return read(spark, d, "embeddings").select("vec_id", dot(lambda i: i % 2 == 0).alias("p0"), dot(lambda i: i % 4 < 2).alias("p1"))


@add(
    "T14_lookahead",
    f"""WITH {RETURNS},
    f AS (SELECT symbol, ts, r, {slag('r')} AS past, lead(r) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM r),
    m AS (SELECT symbol, 'past' AS feature, corr(past, nxt) AS k, corr(r, past) AS ac FROM f GROUP BY 1 UNION ALL
        SELECT symbol, 'leak', corr(nxt, nxt), corr(r, past) FROM f GROUP BY 1)
    SELECT symbol, feature, round(k, 6) + 0.0 AS corr, abs(k) > 0.3 + abs(ac) AS suspicious FROM m""",
)
def t14(spark, d):
    """Features whose correlation with the next return is beyond what the series' own memory allows."""
    from tidemark.functions.frames import lead

    f = returns(spark, d).withColumns({"past": lag("r"), "leak": lead("r"), "nxt": lead("r")})
    ac = f.groupBy("symbol").agg(F.corr("r", "past").alias("ac"))
    k = f.select("symbol", "nxt", "past", "leak").unpivot(["symbol", "nxt"], ["past", "leak"], "feature", "x").groupBy("symbol", "feature").agg(F.corr("x", "nxt").alias("corr"))
    return k.join(ac, "symbol").select("symbol", "feature", "corr", (F.abs("corr") > 0.3 + F.abs("ac")).alias("suspicious"))


@add(
    "T15_fold_isolation",
    """WITH f AS (SELECT CAST(floor(l_orderkey / 1500) AS BIGINT) % 2 AS fold, l_shipdate FROM lineitem)
    SELECT fold, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n FROM f GROUP BY 1""",
)
def t15(spark, d):
    fold = F.floor(c("l_orderkey") / 1500) % 2
    return read(spark, d, "lineitem").groupBy(fold.alias("fold")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("n"))


@add("T22_block_bootstrap", None)
def t22(spark, d):
    """Bands of the mean return from resampled blocks."""
    from tidemark.operators import evaluation as E

    r = returns(spark, d).withColumn("i", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long"))
    return E.bootstrap(r, "symbol", "i", "r", "block")


@add(
    "T23_promotion",
    """WITH m AS (SELECT l_returnflag AS model, avg(l_discount - 0.045) / stddev_samp(l_discount - 0.045) * sqrt(252) AS sharpe, CAST(count(*) AS DOUBLE) AS trades,
        avg(CAST(l_discount > 0.045 AS INT)) AS win_rate FROM lineitem GROUP BY 1),
    l AS (UNPIVOT m ON sharpe, trades, win_rate INTO NAME metric VALUE value)
    SELECT model, metric, round(value, 6) + 0.0 AS value, value >= CASE metric WHEN 'sharpe' THEN 1.5 WHEN 'trades' THEN 500 ELSE 0.5 END AS passed
    FROM l""",
)
def t23(spark, d):
    x = c("l_discount") - 0.045
    m = read(spark, d, "lineitem").groupBy(c("l_returnflag").alias("model")).agg((F.avg(x) / F.stddev_samp(x) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.count(F.lit(1)).cast("double").alias("trades"), F.avg((c("l_discount") > 0.045).cast("int")).alias("win_rate"))
    least = F.create_map(F.lit("sharpe"), F.lit(1.5), F.lit("trades"), F.lit(500.0), F.lit("win_rate"), F.lit(0.5))
    return m.unpivot(["model"], ["sharpe", "trades", "win_rate"], "metric", "value").withColumn("passed", c("value") >= least[c("metric")])


@add(
    "T24_champion",
    """WITH m AS (SELECT l_returnflag AS model, avg(l_discount) AS score FROM lineitem GROUP BY 1)
    SELECT a.model AS champion, b.model AS challenger, round(b.score - a.score, 6) + 0.0 AS gain, b.score > a.score AS better
    FROM m a JOIN m b ON a.model = 'N' AND b.model <> 'N'""",
    9,
)
def t24(spark, d):
    g = read(spark, d, "lineitem").groupBy(c("l_returnflag").alias("model")).agg(F.avg("l_discount").alias("score"))
    best = g.filter("model = 'N'").select(c("model").alias("champion"), c("score").alias("_s"))
    return g.filter("model <> 'N'").join(F.broadcast(best), F.lit(True)).select("champion", c("model").alias("challenger"), (c("score") - c("_s")).alias("gain"), (c("score") > c("_s")).alias("better"))


SQL["T24_champion"] = SQL["T24_champion"].replace(", 6) + 0.0", ", 9) + 0.0")
