"""Queries for labels, contracts and splits, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.operators import passage
from tidemark.operators import bars as B
from tidemark.operators import governance as G
from tidemark.operators import indicators as I
from tidemark.operators import labels as L
from tidemark.plans.sql import BARS, TICKS, lag, roll
from tidemark.sources.tables import read, ticks

QUERIES, SQL = {}, {}


def c(name):
    return F.col(name)


R = lambda *cols: ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in cols)
TR = f"(SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM (SELECT *, {lag('close')} AS pc FROM bars))"
ATR = f"{BARS}, x AS (SELECT *, {roll('avg', 'tr', 6)} AS atr_6 FROM {TR})"
LIST = lambda e, a, b: f"list({e}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"
HIT = lambda p, test: f"(list_position(list_transform({p}, lambda v: {test}), true) - 1)"


def add(name, sql, digits=6):
    def put(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            SQL[name] = sql
        return f

    return put


def with_atr(spark, d):
    return I.atr(B.time_bars(ticks(spark, d)), (6,))


def barrier_sql(horizon, profit, stop):
    side = lambda p, s: f"CASE WHEN NOT whole THEN NULL WHEN {p} IS NOT NULL AND ({s} IS NULL OR {p} <= {s}) THEN 1 WHEN {s} IS NOT NULL THEN -1 ELSE 0 END"
    return f"""WITH {ATR},
    p AS (SELECT *, {LIST('bid_close', 2, horizon + 1)} AS pb, {LIST('ask_close', 2, horizon + 1)} AS pa, lead(ask_close) OVER w AS el,
        lead(bid_close) OVER w AS es, lead(atr_6) OVER w AS a FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    h AS (SELECT *, coalesce(len(pb), 0) = {horizon} AND a IS NOT NULL AS whole, {HIT('pb', f'v >= el + {profit} * a')} AS lp,
        {HIT('pb', f'v <= el - {stop} * a')} AS ls, {HIT('pa', f'v <= es - {profit} * a')} AS sp, {HIT('pa', f'v >= es + {stop} * a')} AS ss FROM p),
    o AS (SELECT *, {side('lp', 'ls')} AS long_outcome, {side('sp', 'ss')} AS short_outcome FROM h)
    SELECT symbol, ts, long_outcome, short_outcome, CASE WHEN whole THEN CAST(coalesce(least(lp, ls), {horizon}) AS INT) END AS long_time,
           CASE WHEN whole THEN CAST(coalesce(least(sp, ss), {horizon}) AS INT) END AS short_time,
           CAST(long_outcome = 1 AS INT) - CAST(short_outcome = 1 AS INT) AS tb_label FROM o"""


BARRIER = ["symbol", "ts", "long_outcome", "short_outcome", "long_time", "short_time", "tb_label"]


@add("L1_long_barrier", barrier_sql(60, 5.0, 4.0))
def l1_long(spark, d):
    """A long horizon with far barriers, by tables of ranges' extremes."""
    return passage.triple_barrier(with_atr(spark, d), 60, profit=5.0, stop=4.0).select(*BARRIER)


@add("L1_triple_barrier", barrier_sql(10, 1.2, 0.8))
def l1(spark, d):
    return L.triple_barrier(with_atr(spark, d)).select(*BARRIER)


@add("L2_L4_reward", f"""WITH {ATR},
    p AS (SELECT *, {LIST('close', 1, 10)} AS p FROM x),
    h AS (SELECT *, coalesce(len(p), 0) = 10 AND atr_6 IS NOT NULL AS whole, {HIT('p', 'v >= close + 1.2 * atr_6 OR v <= close - 0.8 * atr_6')} AS h
        FROM p),
    e AS (SELECT *, CASE WHEN whole THEN p[coalesce(h, 9) + 1] END - close AS mv, p[1:coalesce(h, 9) + 1] AS seen FROM h),
    m AS (SELECT *, mv - 0.02 AS reward, CASE WHEN NOT whole THEN NULL WHEN h IS NULL THEN 'timeout' WHEN mv > 0 THEN 'profit' ELSE 'stop' END AS exit, CASE WHEN whole THEN greatest(close - list_min(seen), 0.0) END AS mae, CASE WHEN whole THEN greatest(list_max(seen) - close, 0.0) END AS mfe FROM e)
    SELECT symbol, ts, exit, {R('reward', 'mae', 'mfe')}, round(CASE WHEN whole THEN mfe / (mfe + mae + 1e-9) END, 6) + 0.0 AS path_quality FROM m""")
def l2(spark, d):
    return L.reward(with_atr(spark, d)).select("symbol", "ts", "exit", "reward", "mae", "mfe", "path_quality")


PARAMS = [("click", 1.33, 1.66, 7), ("error", 1.0, 1.0, 10), ("purchase", 0.66, 0.88, 13), ("signup", 0.66, 0.88, 5), ("view", 1.33, 1.33, 10)]


@add("L3_conditional", f"""WITH {ATR},
    q(symbol, profit, stop, horizon) AS (VALUES {', '.join(map(str, PARAMS))}),
    p AS (SELECT x.*, profit, stop, horizon, ({LIST('close', 1, 13)})[1:horizon] AS p FROM x JOIN q USING (symbol)),
    h AS (SELECT *, coalesce(len(p), 0) = horizon AND atr_6 IS NOT NULL AS whole, {HIT('p', 'v >= close + profit * atr_6')} AS u, {HIT('p', 'v <= close - stop * atr_6')} AS dn FROM p)
    SELECT symbol, ts, CASE WHEN NOT whole THEN NULL WHEN u IS NOT NULL AND (dn IS NULL OR u <= dn) THEN 1 WHEN dn IS NOT NULL THEN -1 ELSE 0 END AS label FROM h""")
def l3(spark, d):
    params = spark.createDataFrame(PARAMS, "symbol string, profit double, stop double, horizon int")
    return L.conditional_horizon(with_atr(spark, d), params, ["symbol"], 13).select("symbol", "ts", "label")


@add(
    "L5_slippage",
    f"""WITH {ATR}
    SELECT symbol, ts, round(least((greatest(atr_6 / ({roll('q0.5', 'atr_6', 60, 10)} + 1e-9), 1.0) + greatest(spread / ({roll('q0.5', 'spread', 60, 10)} + 1e-9), 1.0)) / 2, 3.0),
        6) + 0.0 AS slippage_mult FROM x""",
)
def l5(spark, d):
    return L.slippage_multiplier(with_atr(spark, d)).select("symbol", "ts", "slippage_mult")


@add("L6_utility", f"""WITH {ATR},
    p AS (SELECT *, close + spread / 2 AS e, {LIST('low - spread / 2', 1, 10)} AS lo, {LIST('high - spread / 2', 1, 10)} AS hi, {LIST('close - spread / 2', 1, 10)} AS z
        FROM x),
    h AS (SELECT *, coalesce(len(lo), 0) = 10 AND atr_6 IS NOT NULL AS whole, {HIT('lo', 'v <= e - 0.8 * atr_6')} AS s, {HIT('hi', 'v >= e + 1.2 * atr_6')} AS t FROM p)
    SELECT symbol, ts, round(CASE WHEN NOT whole THEN NULL WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN (e - 0.8 * atr_6) - e WHEN t IS NOT NULL THEN (e + 1.2 * atr_6) - e ELSE z[10] - e END, 6) + 0.0 AS utility FROM h""")
def l6(spark, d):
    return L.executable_utility(with_atr(spark, d)).select("symbol", "ts", "utility")


@add("L7_path_quantiles", f"""WITH {ATR},
    p AS (SELECT *, list_sort(list_transform({LIST('close', 1, 10)}, lambda v: v - close)) AS p FROM x),
    q AS (SELECT symbol, ts, CASE WHEN len(p) = 10 THEN p[2] END AS q10, CASE WHEN len(p) = 10 THEN p[6] END AS q50, CASE WHEN len(p) = 10 THEN p[9] END AS q90
        FROM p)
    SELECT symbol, ts, {R('q10', 'q50', 'q90')}, CASE WHEN q10 > 0 THEN 1 WHEN q90 < 0 THEN -1 WHEN q10 IS NOT NULL THEN 0 END AS conviction FROM q""")
def l7(spark, d):
    return L.path_quantiles(with_atr(spark, d)).select("symbol", "ts", "q10", "q50", "q90", "conviction")


@add("L8_barrier_grid", f"""WITH {ATR},
    g AS (SELECT unnest([0.8, 1.2, 1.6]) AS profit),
    p AS (SELECT *, {LIST('close', 1, 10)} AS p FROM x),
    h AS (SELECT g.profit, close, atr_6, {HIT('p', 'v >= close + g.profit * atr_6')} AS u, {HIT('p', 'v <= close - 0.8 * atr_6')} AS dn
        FROM p, g WHERE len(p) = 10 AND atr_6 IS NOT NULL),
    r AS (SELECT profit, CASE WHEN u IS NOT NULL AND (dn IS NULL OR u <= dn) THEN profit WHEN dn IS NOT NULL THEN -0.8 ELSE 0.0 END AS r FROM h) SELECT profit, count(*) AS n, round(avg(r), 6) + 0.0 AS mean_r, round(avg(CAST(r > 0 AS INT)), 6) + 0.0 AS win_rate FROM r GROUP BY 1""")
def l8(spark, d):
    """One table of ranges' extremes a bucket serves all parameters."""
    return passage.barrier_grid(with_atr(spark, d), [0.8, 1.2, 1.6], 0.8, 10)


@add(
    "L9_difficulty",
    f"""WITH {ATR}
    SELECT symbol, ts, greatest(CASE WHEN hour(ts) = 0 THEN 2 ELSE 0 END, CASE WHEN spread > 0.031 THEN 1 ELSE 0 END, CASE WHEN atr_6 > 440 THEN 2 WHEN atr_6 > 400 THEN 1 ELSE 0 END) AS difficulty
    FROM x""",
)
def l9(spark, d):
    parts = (F.when(F.hour("ts") == 0, 2).otherwise(0), F.when(c("spread") > 0.031, 1).otherwise(0), F.when(c("atr_6") > 440, 2).when(c("atr_6") > 400, 1).otherwise(0))
    return with_atr(spark, d).select("symbol", "ts", F.greatest(*parts).alias("difficulty"))


SEQ = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"


@add("L10_L11_sequences", f"""WITH {BARS}, s AS (SELECT symbol, ts, list(close) {SEQ} AS q, sum(CAST(spread > 0.03401 AS INT)) {SEQ} AS bad FROM bars)
    SELECT symbol, ts, CAST(len(list_filter(q, lambda v, i: (12 - i) % 3 = 0)) AS INT) AS steps, round(list_sum(list_filter(q, lambda v, i: (12 - i) % 3 = 0)), 6) + 0.0 AS total FROM s WHERE len(q) = 12 AND bad <= 0.6""")
def l10(spark, d):
    b = B.time_bars(ticks(spark, d)).withColumn("bad", (c("spread") > 0.03401).cast("int"))
    s = L.sequences(b, ["close"], 12, every=3, bad="bad")
    return s.select("symbol", "ts", F.size("sequence").alias("steps"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]).alias("total"))


@add(
    "L12_contamination",
    f"""WITH {BARS},
    l AS (SELECT symbol, ts, lead(ts, 10) OVER (PARTITION BY symbol ORDER BY ts) AS label_end FROM bars)
    SELECT symbol, count(*) AS n, count(*) FILTER (label_end > TIMESTAMP '2024-01-20') AS leaks FROM l WHERE ts < TIMESTAMP '2024-01-20'
    GROUP BY 1""",
)
def l12(spark, d):
    """Training rows whose label looks past the cut."""
    from tidemark.functions.frames import lead

    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return B.time_bars(ticks(spark, d)).withColumn("label_end", lead("ts", 10)).filter(c("ts") < cut).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("label_end") > cut).alias("leaks"))


W13 = "least((CASE WHEN l_linenumber <= 3 THEN 0.7 ELSE 0.3 END) / (0.1 + 0.8 * l_discount * 10), 5.0)"


@add("L13_off_policy", f"""WITH a AS (SELECT l_returnflag, {W13} AS w, l_tax AS r, 0.04 AS q FROM lineitem) SELECT l_returnflag, round(avg(w * r), 6) + 0.0 AS ips, round(stddev_pop(w * r), 6) + 0.0 AS ips_std, round(sum(w * r) / sum(w), 6) + 0.0 AS snips, round(avg(q + w * (r - q)), 6) + 0.0 AS doubly_robust FROM a GROUP BY 1""")
def l13(spark, d):
    w = F.least(F.when(c("l_linenumber") <= 3, 0.7).otherwise(0.3) / (0.1 + 0.8 * c("l_discount") * 10), F.lit(5.0))
    x = read(spark, d, "lineitem").select("l_returnflag", w.alias("w"), c("l_tax").alias("r"))
    return x.groupBy("l_returnflag").agg(F.avg(c("w") * c("r")).alias("ips"), F.stddev_pop(c("w") * c("r")).alias("ips_std"), (F.sum(c("w") * c("r")) / F.sum("w")).alias("snips"), F.avg(0.04 + c("w") * (c("r") - 0.04)).alias("doubly_robust"))


@add("L14_conformal", """WITH l AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS z FROM embeddings),
    s AS (SELECT vec_id, list_transform(z, lambda v: v / list_sum(z)) AS p FROM l), q AS (SELECT quantile_cont(1 - list_max(p), 0.9) AS t FROM s)
    SELECT vec_id, round(list_max(p), 6) + 0.0 AS confidence, CAST(len(list_filter(p, lambda v: 1 - v <= t)) AS INT) AS set_size FROM s, q""")
def l14(spark, d):
    """Softmax over the logits, and how many classes the conformal threshold lets in."""
    z = F.transform("embedding", lambda v: F.exp(v.cast("double")))
    s = read(spark, d, "embeddings").select("vec_id", z.alias("z"))
    s = s.select("vec_id", F.transform("z", lambda v: v / F.aggregate("z", F.lit(0.0), lambda a, x: a + x)).alias("p"))
    t = s.agg(F.percentile(1 - F.array_max("p"), 0.9).alias("t"))
    return s.join(F.broadcast(t), F.lit(True)).select("vec_id", F.array_max("p").alias("confidence"), F.size(F.filter("p", lambda v: 1 - v <= c("t"))).alias("set_size"))


@add(
    "L15_consensus",
    f"""WITH {BARS},
    v AS (SELECT ts, avg(sign(close - open)) AS m FROM bars GROUP BY 1)
    SELECT ts, CAST(CASE WHEN abs(m) < 0.33 THEN 0 ELSE sign(m) END AS INT) AS label FROM v""",
)
def l15(spark, d):
    m = F.avg(F.signum(c("close") - c("open")))
    return B.time_bars(ticks(spark, d)).groupBy("ts").agg(m.alias("m")).select("ts", F.when(F.abs("m") < 0.33, 0).otherwise(F.signum("m")).cast("int").alias("label"))


# contracts, gates and splits
@add("G1_G2_tick_contract", f"""WITH {TICKS}
    SELECT rule, violations FROM (SELECT count(*) FILTER (symbol IS NULL) AS "not_null:symbol", count(*) FILTER (ts IS NULL) AS "not_null:ts",
        count(*) FILTER (bid IS NULL) AS "not_null:bid", count(*) FILTER (ask IS NULL) AS "not_null:ask", count(*) FILTER (NOT mid BETWEEN 5 AND 480) AS "bounds:mid",
    count(*) FILTER (NOT volume BETWEEN 0 AND 1e9) AS "bounds:volume", count(*) FILTER (symbol NOT IN ('click', 'error', 'purchase', 'signup', 'view')) AS "allowed:symbol", count(*) FILTER (NOT bid < ask) AS "invariant:uncrossed", count(*) FILTER (NOT mid BETWEEN bid AND ask) AS "invariant:mid_inside" FROM ticks) UNPIVOT (violations FOR rule IN (*))""")
def g1(spark, d):
    return G.tick_contract(["click", "error", "purchase", "signup", "view"], (5.0, 480.0)).check(ticks(spark, d))


@add("G2_bar_contract", f"""WITH {BARS}
    SELECT rule, violations FROM (SELECT count(*) FILTER (symbol IS NULL) AS "not_null:symbol", count(*) FILTER (ts IS NULL) AS "not_null:ts",
        count(*) FILTER (close IS NULL) AS "not_null:close", count(*) FILTER (NOT close BETWEEN 5 AND 480) AS "bounds:close",
    count(*) FILTER (high < greatest(open, close)) AS "invariant:high_is_highest", count(*) FILTER (low > least(open, close)) AS "invariant:low_is_lowest" FROM bars) UNPIVOT (violations FOR rule IN (*))""")
def g2(spark, d):
    return G.bar_contract((5.0, 480.0)).check(B.time_bars(ticks(spark, d)))


@add("G3_gates", """SELECT gate, round(value, 6) + 0.0 AS value, CASE WHEN gate = 'row_count' THEN value >= 100 ELSE value <= 0.3 END AS passed FROM (SELECT CAST(count(*) AS DOUBLE) AS row_count, avg(CAST(l.quality IS NULL AS INT)) AS "nulls:quality", avg(CAST(d.lang IS NULL AS INT)) AS "nulls:lang" FROM documents d LEFT JOIN labels l USING (doc_id)) UNPIVOT (value FOR gate IN (*))""")
def g3(spark, d):
    j = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id", "left")
    return G.gates(j, 100, 0.3, ["quality", "lang"])


@add("G4_quality_checks", f"""WITH {BARS},
    b AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS bf, count(*) OVER (PARTITION BY symbol, ts) AS same
        FROM bars)
    SELECT "check", count FROM (SELECT count(*) FILTER (close IS NULL) AS null_close, count(*) FILTER (isnan(close) OR isinf(close)) AS not_finite, count(*) FILTER (same > 1) AS duplicate_ts, count(*) FILTER (bf > ts) AS not_monotonic, count(*) FILTER (isodow(ts) >= 6) AS weekend, count(*) FILTER (bid_close >= ask_close) AS crossed,
    count(*) FILTER (spread > 0.035) AS wide_spread, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS bad_ohlc, count(*) FILTER (high = low) AS flat FROM b) UNPIVOT (count FOR "check" IN (*))""")
def g4(spark, d):
    return G.quality_checks(B.time_bars(ticks(spark, d)).withColumn("id", c("ts")))


ROWS = "x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row, count(*) OVER () AS n FROM orders)"


def ordered(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return G.numbered(o, ["o_orderdate", "o_orderkey"], F.to_date("o_orderdate"))


@add(
    "G8_walk_forward",
    f"""WITH {ROWS},
    f AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS fold),
    r AS (SELECT o_orderkey, row, fold, CASE WHEN row < floor(n * (0.4 + 0.15 * fold)) - 20 THEN 'train' WHEN row >= floor(n * (0.4 + 0.15 * fold)) AND row < least(floor(n * (0.4 + 0.15 * (fold + 1))), n) THEN 'validate' END AS role
        FROM x, f)
    SELECT fold, role, count(*) AS n, min(row) AS first, max(row) AS last, CAST(sum(o_orderkey) AS BIGINT) AS keys
    FROM r WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def g8(spark, d):
    w = G.walk_forward(ordered(spark, d), 4, 0.4, 0.15, 20)
    return w.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("row").alias("last"), F.sum("o_orderkey").alias("keys"))


def cv_sql(groups, chosen, purge):
    folds = ", ".join(f"({k}, {list(t)})" for k, t in enumerate(chosen))
    return f"""WITH {ROWS}, f(fold, t) AS (VALUES {folds}), r AS (SELECT o_orderkey, row, fold, CASE WHEN list_contains(t, CAST(floor(row / ceil(n / {groups})) AS INT)) THEN 'test'
    WHEN len(list_filter(t, lambda g: row >= g * ceil(n / {groups}) - {purge} AND row < (g + 1) * ceil(n / {groups}) + {purge})) = 0 THEN 'train' END AS role FROM x, f) SELECT CAST(fold AS INT) AS fold, role, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM r WHERE role IS NOT NULL GROUP BY 1, 2"""


def counted(w):
    return w.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@add("G9_combinatorial_cv", cv_sql(5, [(a, b) for a in range(5) for b in range(a + 1, 5)], 15))
def g9(spark, d):
    return counted(G.combinatorial(ordered(spark, d), 5, 2, 15))


@add("G10_purged_kfold", cv_sql(5, [(k,) for k in range(5)], 25))
def g10(spark, d):
    return counted(G.purged_kfold(ordered(spark, d), 5, 25))


@add(
    "G11_lockbox",
    """SELECT count(*) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS open_rows, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS locked,
        count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem
        WHERE l_shipdate < TIMESTAMP '1996-01-01')) AS leaks FROM orders""",
)
def g11(spark, d):
    day = F.lit("2001-01-01").cast("timestamp")
    early = read(spark, d, "lineitem").filter(c("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).select(c("l_orderkey").alias("o_orderkey"), F.lit(1).alias("seen")).distinct()
    o = read(spark, d, "orders").join(early, "o_orderkey", "left")
    locked = c("o_orderdate") >= day
    return o.agg(F.count_if(~locked).alias("open_rows"), F.count_if(locked).alias("locked"), F.count_if(locked & c("seen").isNotNull()).alias("leaks"))


@add(
    "G12_dependencies",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS node, 'o' || o_orderkey AS needs FROM orders UNION SELECT DISTINCT 'o' || l_orderkey,
        'p' || l_partkey FROM lineitem),
    b AS (SELECT 'c' || o_custkey AS node FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)),
    up(node, depth) AS (SELECT DISTINCT needs, 1 FROM e WHERE node IN (SELECT node FROM b) UNION SELECT e.needs, depth + 1
        FROM up JOIN e ON e.node = up.node)
    SELECT node, CAST(min(depth) AS INT) AS depth FROM up GROUP BY 1""",
)
def g12(spark, d):
    """A dependency graph out of customers, orders and parts, from the customers with a large order."""
    text = lambda p, x: F.concat(F.lit(p), c(x).cast("string"))
    orders = read(spark, d, "orders")
    large = orders.join(F.broadcast(orders.agg((1.5 * F.avg("o_totalprice")).alias("_least"))), c("o_totalprice") > c("_least")).select(text("c", "o_custkey").alias("node"))
    e = orders.select(text("c", "o_custkey").alias("node"), text("o", "o_orderkey").alias("needs"))
    e = e.unionByName(read(spark, d, "lineitem").select(text("o", "l_orderkey").alias("node"), text("p", "l_partkey").alias("needs"))).distinct()
    return G.ancestors(e, large)


@add("G16_parity", f"""WITH {TICKS},
    a AS (SELECT symbol, time_bucket(INTERVAL '6 hours', ts) AS b, last(mid ORDER BY ts, id) AS close FROM ticks GROUP BY ALL),
    h AS (SELECT symbol, time_bucket(INTERVAL '30 minutes', ts) AS h, last(mid ORDER BY ts, id) AS close FROM ticks GROUP BY ALL),
    g AS (SELECT symbol, time_bucket(INTERVAL '6 hours', h) AS b, last(close ORDER BY h) AS again FROM h GROUP BY ALL),
    w AS (SELECT max(abs(close - again)) AS worst FROM a JOIN g USING (symbol, b))
    SELECT 'close' AS "column", round(worst, 6) + 0.0 AS worst, worst <= 1e-5 AS passed FROM w""")
def g16(spark, d):
    """Closes from ticks against closes from half-hour bars put together again."""
    t = ticks(spark, d)
    half = B.time_bars(t, "30 minutes")
    again = half.groupBy("symbol", F.window("ts", "6 hours").start.alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    return G.parity(B.time_bars(t), again, ["symbol", "ts"], ["close"])


@add(
    "G17_verification",
    """SELECT count(*) AS rows, count(*) FILTER (isnan(l_extendedprice)) AS not_finite, count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.1) AS out_of_range,
        count(DISTINCT l_returnflag) AS classes, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated
    FROM lineitem""",
)
def g17(spark, d):
    n = F.count(F.lit(1))
    return read(spark, d, "lineitem").agg(n.alias("rows"), F.count_if(F.isnan("l_extendedprice")).alias("not_finite"), F.count_if(~c("l_discount").between(0, 0.1)).alias("out_of_range"), F.countDistinct("l_returnflag").alias("classes"), (n - F.countDistinct("l_orderkey", "l_linenumber")).alias("repeated"))


@add("G18_fingerprint", None)
def g18(spark, d):
    return G.fingerprint(read(spark, d, "orders"))
