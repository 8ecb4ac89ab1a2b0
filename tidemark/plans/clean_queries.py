"""Queries for cleaning, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.operators import clean as C
from tidemark.operators.bars import time_bars
from tidemark.plans.sql import BARS, TICKS, roll
from tidemark.sources.tables import read, ticks

QUERIES, SQL = {}, {}
QUOTE = ["bid", "ask", "mid", "spread"]
R = lambda *cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)
OPEN = "NOT (isodow(ts) = 6 OR (isodow(ts) = 5 AND hour(ts) >= 22) OR (isodow(ts) = 7 AND hour(ts) < 22))"


def add(name, sql):
    def put(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        SQL[name] = sql
        return f

    return put


@add("C1_standardise", f"WITH {TICKS} SELECT id, symbol, ts, {R(*QUOTE)} FROM ticks WHERE ask - bid > 0")
def c1(spark, d):
    raw = ticks(spark, d).select(F.col("ts").alias("timestamp_utc"), F.col("symbol").alias("pair"), "id", "bid", "ask")
    return C.standardise(raw, C.NAMES).select("id", "symbol", "ts", *QUOTE)


@add(
    "C2_enforce",
    f"""WITH {TICKS}
    SELECT symbol, h AS ts, arg_min(id, id) AS id FROM (SELECT *, date_trunc('hour', ts) AS h FROM ticks) WHERE bid < ask
    GROUP BY ALL""",
)
def c2(spark, d):
    t = ticks(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return C.enforce(t, ["symbol", "ts"], "id").select("symbol", "ts", "id")


B4 = "OVER (PARTITION BY symbol ORDER BY ts, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@add("C3_bad_ticks", f"""WITH {TICKS},
    a AS (SELECT *, CASE WHEN count(mid) {B4} >= 5 THEN avg(mid) {B4} END AS m, CASE WHEN count(mid) {B4} >= 5 THEN stddev_samp(mid) {B4} END AS s,
    CASE WHEN count(mid) {B4} >= 5 THEN quantile_cont(mid, 0.5) {B4} END AS med, CASE WHEN count(mid) {B4} >= 5 THEN quantile_cont(spread, 0.5) {B4} END AS sp FROM ticks),
    b AS (SELECT *, abs(mid - med) AS dev FROM a), e AS (SELECT *, CASE WHEN count(dev) {B4} >= 5 THEN quantile_cont(dev, 0.5) {B4} END AS mad FROM b),
    f AS (SELECT *, coalesce((abs(mid - m) / (s + 1e-9) > 3 OR 0.6745 * dev / (mad + 1e-9) > 6) AND NOT spread > 8 * sp, false) AS is_bad FROM e),
    g AS (SELECT id, is_bad, CASE WHEN is_bad THEN med ELSE mid END AS mid, spread FROM f) SELECT id, is_bad, {R('mid')}, round(mid - spread / 2, 6) + 0.0 AS bid FROM g""")
def c3(spark, d):
    return C.bad_ticks(ticks(spark, d)).select("id", "is_bad", "mid", "bid")


@add("C4_weekend", f"WITH {TICKS} SELECT id, ts FROM ticks WHERE {OPEN}")
def c4(spark, d):
    return ticks(spark, d).filter(C.in_market()).select("id", "ts")


@add(
    "C5_holidays",
    f"""WITH {TICKS}
    SELECT id, ts FROM ticks WHERE CAST(ts AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) - INTERVAL '6 years'
        FROM orders WHERE o_totalprice > 400000) AND strftime(ts, '%m-%d') NOT IN ('01-01', '12-25')""",
)
def c5(spark, d):
    """A calendar from the orders table, and the fixed days."""
    days = read(spark, d, "orders").filter("o_totalprice > 400000").select(F.to_date(F.col("o_orderdate") - F.expr("INTERVAL 6 YEARS")).alias("day")).distinct()
    return C.without_days(ticks(spark, d).filter(~F.date_format("ts", "MM-dd").isin("01-01", "12-25")), days).select("id", "ts")


@add(
    "C6_thin_days",
    f"""WITH {TICKS},
    v AS (SELECT CAST(ts AS DATE) AS day, sum(volume) AS v FROM ticks GROUP BY 1)
    SELECT id FROM ticks WHERE CAST(ts AS DATE) NOT IN (SELECT day FROM v WHERE v < 0.98 * (SELECT quantile_cont(v, 0.5)
        FROM v))""",
)
def c6(spark, d):
    t = ticks(spark, d)
    return C.without_days(t, C.thin_days(t, 0.98)).select("id")


@add("C7_dead_bars", f"WITH {BARS} SELECT symbol, ts, n FROM bars WHERE NOT (high = low AND volume < 1)")
def c7(spark, d):
    return time_bars(ticks(spark, d)).filter(~((F.col("high") == F.col("low")) & (F.col("volume") < 1))).select("symbol", "ts", "n")


RANGES = "(SELECT symbol, min(ts) + INTERVAL 3 DAY AS a, min(ts) + INTERVAL 5 DAY AS b FROM ticks GROUP BY symbol)"


@add("C8_embargo", f"WITH {TICKS} SELECT id FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM {RANGES} r WHERE r.symbol = t.symbol AND t.ts BETWEEN a AND b)")
def c8(spark, d):
    t = ticks(spark, d)
    r = t.groupBy("symbol").agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("start"), (F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("end"))
    return C.outside_ranges(t, r).select("id")


@add("C9_gaps", f"""WITH {TICKS}, g AS (SELECT symbol, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id))) / 1e6 AS d FROM ticks)
    SELECT symbol, count(*) FILTER (d > 1800) AS gaps, CAST(coalesce(sum(floor(d / 1800) - 1) FILTER (d > 1800), 0) AS BIGINT) AS missing, round(coalesce(max(d) FILTER (d > 1800), 0.0), 6) + 0.0 AS longest_s FROM g GROUP BY symbol""")
def c9(spark, d):
    return C.gaps(ticks(spark, d), 1800)


GRID = f"""WITH {TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL '30 minutes', ts) AS ts, last(mid ORDER BY ts, id) AS close FROM ticks GROUP BY ALL),
    g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts FROM b GROUP BY symbol),
    f AS (SELECT g.symbol, g.ts, b.close FROM g LEFT JOIN b USING (symbol, ts)),
    p AS (SELECT f.*, x.ts AS pt, x.close AS px FROM f ASOF LEFT JOIN b x ON f.symbol = x.symbol AND f.ts >= x.ts),
    q AS (SELECT p.*, x.ts AS nt, x.close AS nx, epoch(p.ts - p.pt) AS age FROM p ASOF LEFT JOIN b x ON p.symbol = x.symbol AND p.ts <= x.ts)"""


@add("C10_fill_ffill", f"{GRID} SELECT symbol, ts, round(CASE WHEN age <= 7200 THEN px END, 6) + 0.0 AS close, close IS NULL AND age <= 7200 AS filled FROM q")
def c10(spark, d):
    return C.fill_grid(time_bars(ticks(spark, d), "30 minutes"), "30 MINUTES", 1800, 7200)


@add(
    "C10_fill_interpolate",
    f"""{GRID}
    SELECT symbol, ts, round(CASE WHEN close IS NOT NULL THEN close WHEN age <= 7200 THEN coalesce(px + (nx - px) * age / nullif(epoch(nt - pt), 0), px) END,
        6) + 0.0 AS close, close IS NULL AND age <= 7200 AS filled FROM q""",
)
def c10b(spark, d):
    return C.fill_grid(time_bars(ticks(spark, d), "30 minutes"), "30 MINUTES", 1800, 7200, "interpolate")


A, L, N = "hour(ts) < 8", "hour(ts) BETWEEN 7 AND 15", "hour(ts) BETWEEN 12 AND 20"
SESSION = f"CASE WHEN {L} AND {N} THEN 'london_ny' WHEN {A} AND {L} THEN 'asia_london' WHEN {L} THEN 'london' WHEN {N} THEN 'ny' WHEN {A} THEN 'asia' ELSE 'off' END"


@add("C11_sessions", f"WITH {TICKS} SELECT id, {SESSION} AS session, ({L} AND {N}) OR ({A} AND {L}) AS overlap FROM ticks")
def c11(spark, d):
    return C.fixed_sessions(ticks(spark, d)).select("id", "session", "overlap")


def local_sql(zone, a, b):
    t = f"timezone('{zone}', timezone('UTC', ts))"
    return f"CAST(hour({t}) * 60 + minute({t}) BETWEEN {a} AND {b - 1} AND isodow({t}) < 6 AS INT)"


@add("C12_local_sessions", f"WITH {TICKS} SELECT id, {', '.join(f'{local_sql(*v)} AS in_{k}' for k, v in C.SESSIONS.items())} FROM ticks")
def c12(spark, d):
    return C.local_sessions(ticks(spark, d)).select("id", *[f"in_{k}" for k in C.SESSIONS])


@add("C13_session_cost", f"WITH {TICKS} SELECT id, CASE {SESSION} {' '.join(f'WHEN {k!r} THEN {v}' for k, v in C.SESSION_COST.items())} END AS cost FROM ticks")
def c13(spark, d):
    costs = F.create_map(*[x for k, v in C.SESSION_COST.items() for x in (F.lit(k), F.lit(v))])
    return C.fixed_sessions(ticks(spark, d)).select("id", costs[F.col("session")].alias("cost"))


@add("C14_sanitise", f"""WITH {TICKS}, a AS (SELECT id, symbol, ts, CASE WHEN volume <= 20 THEN NULL ELSE mid * 3000 END AS x FROM ticks)
    SELECT id, round(greatest(least(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 0.0), 1e6), -1e6), 6) + 0.0 AS x FROM a""")
def c14(spark, d):
    x = F.when(F.col("volume") <= 10, F.lit(float("inf"))).when(F.col("volume") <= 20, F.lit(float("nan"))).otherwise(F.col("mid") * 3000)
    return C.sanitise(ticks(spark, d).withColumn("x", x), ["x"], ["symbol"], ["ts", "id"]).select("id", "x")


@add("C15_staleness", f"""WITH {BARS},
    a AS (SELECT symbol, ts, CASE WHEN close > 250 THEN close END AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn
        FROM bars),
    b AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN rn END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM a)
    SELECT symbol, ts, CAST(x IS NULL AS INT) AS x_missing, CAST(l IS NULL AS INT) AS x_never_seen, CAST(rn - l AS INT) AS x_age FROM b""")
def c15(spark, d):
    b = time_bars(ticks(spark, d)).withColumn("x", F.when(F.col("close") > 250, F.col("close")))
    return C.staleness(b, "x").select("symbol", "ts", "x_missing", "x_never_seen", "x_age")


@add(
    "C16_robust_clip",
    f"""WITH {TICKS},
    q AS (SELECT symbol, quantile_cont(mid, 0.01) AS a, quantile_cont(mid, 0.99) AS b FROM ticks GROUP BY 1)
    SELECT id, round(least(greatest(mid, a), b), 6) + 0.0 AS mid FROM ticks JOIN q USING (symbol)""",
)
def c16(spark, d):
    return C.robust_clip(ticks(spark, d), "mid", ["symbol"]).select("id", "mid")


@add("C17_row_quality", f"""WITH {BARS},
    v AS (SELECT CAST(ts AS DATE) AS day, sum(volume) AS v FROM bars GROUP BY 1),
    thin AS (SELECT day FROM v WHERE v < 0.98 * (SELECT quantile_cont(v, 0.5) FROM v)),
    r AS (SELECT symbol, ts, CAST(NOT ({OPEN}) AS INT) AS bad_weekend, CAST(CAST(ts AS DATE) IN (SELECT day FROM thin) AS INT) AS bad_thin, CAST(high = low AND volume < 1 AS INT) AS bad_dead,
    CAST(coalesce(spread > 1.5 * {roll('q0.5', 'spread', 60, 20)}, false) AS INT) AS bad_spread FROM bars)
    SELECT *, CAST(bad_weekend + bad_thin + bad_dead + bad_spread = 0 AS INT) AS row_ok FROM r""")
def c17(spark, d):
    b = time_bars(ticks(spark, d))
    return C.quality_reasons(b, C.thin_days(b, 0.98)).select("symbol", "ts", "bad_weekend", "bad_thin", "bad_dead", "bad_spread", "row_ok")


RULES = [("licence", "(?i)licen[sc]e"), ("secret", "(?i)(token|password|api[_ ]?key)"), ("contact", r"[\w.]+@[\w.]+"), ("shout", "!!")]


RULE_SQL = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in RULES)


@add("C19_text_rules", f"SELECT doc_id, CASE {RULE_SQL} ELSE 'none' END AS category, upper(lang) AS region FROM documents")
def c19(spark, d):
    rule = F.lit("none")
    for k, p in reversed(RULES):
        rule = F.when(F.col("text").rlike(p), k).otherwise(rule)
    return read(spark, d, "documents").select("doc_id", rule.alias("category"), F.upper("lang").alias("region"))


@add("C20_title_fallback", r"""SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END), ''),
    trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9]+', ' ', 'g'))) AS headline FROM pages WHERE regexp_matches(url, '(?i)example\.(com|org)')""")
def c20(spark, d):
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    words = F.trim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[^A-Za-z0-9]+", " "))
    return read(spark, d, "pages").filter(F.col("url").rlike(r"(?i)example\.(com|org)")).select("page_id", F.coalesce(F.nullif(F.trim(title), F.lit("")), words).alias("headline"))


@add(
    "C21_list_overlap",
    """SELECT o_custkey, keys FROM (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS keys
        FROM orders GROUP BY 1) WHERE list_has_any(string_split(keys, ','), ['1-URGENT', '2-HIGH'])""",
)
def c21(spark, d):
    keys = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("keys"))
    return keys.filter(F.arrays_overlap(F.split("keys", ","), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))))


FIGURE = "CASE event_id % 5 WHEN 0 THEN CAST(round(value, 1) AS VARCHAR) || 'K' WHEN 1 THEN '-' || CAST(round(value, 1) AS VARCHAR) || '%' WHEN 2 THEN CAST(CAST(floor(value) AS INT) AS VARCHAR) WHEN 3 THEN 'n/a' ELSE CAST(round(value, 1) AS VARCHAR) || ' B' END"


def figure():
    k, x = F.col("event_id") % 5, F.round("value", 1).cast("string")
    return F.when(k == 0, F.concat(x, F.lit("K"))).when(k == 1, F.concat(F.lit("-"), x, F.lit("%"))).when(k == 2, F.floor("value").cast("string")).when(k == 3, "n/a").otherwise(F.concat(x, F.lit(" B")))


@add("C22_unit_numbers", rf"""SELECT event_id, round(TRY_CAST(regexp_extract(f, '^\s*([-+]?[0-9]*\.?[0-9]+)', 1) AS DOUBLE) * CASE regexp_extract(f, '([KMBT%])\s*$', 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 WHEN '%' THEN 1e-2 ELSE 1 END, 6) + 0.0 AS x FROM (SELECT event_id, {FIGURE} AS f FROM events)""")
def c22(spark, d):
    return read(spark, d, "events").select("event_id", C.unit_number(figure()).alias("x"))


@add("C23_surprise", rf"SELECT event_id, round(TRY_CAST(regexp_replace(f, '[^0-9.\-]', '', 'g') AS DOUBLE) - 100, 6) + 0.0 AS surprise FROM (SELECT event_id, {FIGURE} AS f FROM events)")
def c23(spark, d):
    return read(spark, d, "events").select("event_id", (C.cleaned_number(figure()) - 100).alias("surprise"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@add(
    "C24_one_hot",
    f"""SELECT date_trunc('hour', ts) AS ts, {', '.join(f'max(CAST(event_type = {k!r} AS INT)) AS is_{k}' for k in KINDS)}
    FROM events GROUP BY 1""",
)
def c24(spark, d):
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(*[F.max((F.col("event_type") == k).cast("int")).alias(f"is_{k}") for k in KINDS])


@add("C25_sanity", f"""WITH {TICKS},
    u AS (SELECT symbol, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT symbol, ts, count(*) AS n FROM ticks
        GROUP BY ALL) GROUP BY 1)
   
    SELECT t.*, u.duplicates FROM (SELECT symbol, count(*) AS rows, count(*) FILTER (NOT mid BETWEEN 5 AND 480) AS out_of_range, count(*) FILTER (bid >= ask) AS crossed,
        count(*) FILTER (spread > 0.04) AS wide, count(*) FILTER (volume IS NULL) AS no_volume,
    round(avg(spread), 6) + 0.0 AS avg_spread, round(max(spread), 6) + 0.0 AS max_spread FROM ticks GROUP BY 1) t JOIN u USING (symbol)""")
def c25(spark, d):
    return C.sanity(ticks(spark, d), 5, 480)


@add("C26_missing_hours", f"""WITH {TICKS},
    h AS (SELECT DISTINCT user_id AS symbol, date_trunc('hour', ts) AS h FROM events),
    g AS (SELECT symbol, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM h GROUP BY 1),
    m AS (SELECT *, epoch(h) / 3600 - row_number() OVER (PARTITION BY symbol ORDER BY h) AS k FROM g ANTI JOIN h USING (symbol, h)) SELECT symbol, min(h) AS start, max(h) AS "end", count(*) AS hours FROM m GROUP BY symbol, k""")
def c26(spark, d):
    return C.missing_hours(read(spark, d, "events").select(F.col("user_id").alias("symbol"), "ts"))


@add("C27_month_coverage", """WITH m AS (SELECT DISTINCT o_custkey AS k, date_trunc('month', o_orderdate) AS m FROM orders),
    g AS (SELECT k, unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS m
        FROM (SELECT DISTINCT k FROM m))
    SELECT k, strftime(m, '%Y-%m') AS month FROM g ANTI JOIN (SELECT k, CAST(m AS TIMESTAMP) AS m FROM m) USING (k, m)""")
def c27(spark, d):
    have = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.trunc("o_orderdate", "month").alias("m")).distinct()
    span = have.agg(F.min("m").alias("a"), F.max("m").alias("b"))
    grid = have.select("k").distinct().join(F.broadcast(span)).select("k", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return grid.join(have, ["k", "m"], "left_anti").select("k", F.date_format("m", "yyyy-MM").alias("month"))


@add("C28_release_time", """SELECT o_orderkey, timezone('UTC', timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) + CAST((5 - isodow(o_orderdate) + 7) % 7 AS INT) AS TIMESTAMP) + INTERVAL 15 HOUR + INTERVAL 30 MINUTE)) AS release,
    round(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END, 6) + 0.0 AS net FROM orders""")
def c28(spark, d):
    """The Friday on or after a report's date, 15:30 in New York, as UTC; the sign turns where the key is the base."""
    friday = F.date_add(F.to_date("o_orderdate"), (F.lit(4) - F.weekday("o_orderdate") + 7) % 7)
    local = friday.cast("timestamp") + F.expr("INTERVAL '15:30' HOUR TO MINUTE")
    return read(spark, d, "orders").select("o_orderkey", F.to_utc_timestamp(local, "America/New_York").cast("timestamp_ntz").alias("release"), F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("net"))


@add("C29_coverage_years", """SELECT o_orderpriority AS k, round(date_diff('day', min(o_orderdate), max(o_orderdate)) / 365.25, 6) + 0.0 AS years, date_diff('day', min(o_orderdate), max(o_orderdate)) / 365.25 >= 6 AS enough FROM orders GROUP BY 1""")
def c29(spark, d):
    years = F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) / 365.25
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(years.alias("years"), (years >= 6).alias("enough"))


@add("C30_feed_report", f"""WITH {TICKS},
    l AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap, mid = lag(mid) OVER w AND volume = lag(volume) OVER w AS same
        FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, id))
    SELECT symbol, count(*) AS rows, round(avg(gap), 6) + 0.0 AS cadence_s, count(*) FILTER (same) AS repeats, count(*) FILTER (gap > 3600) AS long_gaps, round(avg(CAST(volume IS NULL AS INT)), 6) + 0.0 AS null_volume FROM l GROUP BY 1""")
def c30(spark, d):
    from tidemark.functions.frames import lag

    o = ("ts", "id")
    t = ticks(spark, d)
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(lag("ts", order=o).cast("timestamp"))) / 1e6
    same = (F.col("mid") == lag("mid", order=o)) & (F.col("volume") == lag("volume", order=o))
    return t.withColumns({"gap": gap, "same": same}).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("gap").alias("cadence_s"), F.count_if("same").alias("repeats"), F.count_if(F.col("gap") > 3600).alias("long_gaps"), F.avg(F.col("volume").isNull().cast("int")).alias("null_volume"))
