"""Queries for sources, sinks and streams, and their SQL. Each writes to a shared folder and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.functions.text import HIGH_IMPACT
from tidemark.plans.sql import BARS, TICKS
from tidemark.operators.bars import time_bars
from tidemark.sources import store as S
from tidemark.sources.snapshots import Table, sink
from tidemark.sources.tables import read, ticks
from tidemark.streaming import jobs as J
from tidemark.streaming import state

QUERIES, SQL = {}, {}


def c(name):
    return F.col(name)


def add(name, sql, digits=6):
    def put(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            SQL[name] = sql
        return f

    return put


SPAN = ("2024-01-08", "2024-01-15")
IN = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"


@add("S1_S2_time_range", f"SELECT event_id, ts, value FROM events WHERE {IN}")
def s1(spark, d):
    return S.between(read(spark, d, "events"), *SPAN).select("event_id", "ts", "value")


@add("S3_S4_partitioned", f"WITH {TICKS} SELECT id, symbol, ts FROM ticks WHERE {IN} AND symbol IN ('click', 'view')")
def s3(spark, d):
    """Written by symbol and month, read with both pruned."""
    path = S.shared(spark)
    S.write_partitioned(S.with_parts(ticks(spark, d)), path, ["symbol", "month"], ["ts"])
    t = spark.read.parquet(path).filter(c("symbol").isin("click", "view") & (c("month") == 1))
    return S.between(t, *SPAN).select("id", "symbol", "ts")


@add("S5_refresh", f"WITH {TICKS} SELECT symbol, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids FROM ticks WHERE symbol <> 'error' OR id % 2 = 0 GROUP BY 1")
def s5(spark, d):
    """A first load, then a refresh after one key lost rows: only that key is written again."""
    path, t = S.shared(spark), ticks(spark, d)
    first = S.refresh(t, path, None, "symbol", ["ts"])
    first.write.parquet(path + "-manifest")
    S.refresh(t.filter("symbol <> 'error' or id % 2 = 0"), path, spark.read.parquet(path + "-manifest"), "symbol", ["ts"])
    return spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"))


@add("S6_S7_consolidated", f"WITH {TICKS} SELECT symbol, count(*) AS n, min(ts) AS first, max(ts) AS last FROM ticks GROUP BY 1")
def s6(spark, d):
    path = S.shared(spark)
    S.write_partitioned(ticks(spark, d), path, ["symbol"], ["ts", "id"])
    return spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@add("S8_S9_text_formats", "SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def s8(spark, d):
    """Records as JSON lines and as CSV, read by schema and put together."""
    path = S.shared(spark)
    read(spark, d, "documents").select(c("doc_id").alias("id"), "lang").write.json(path + "/a")
    read(spark, d, "conversations").select(c("conv_id").alias("id"), "role").write.option("header", True).csv(path + "/b")
    return S.diagonal([S.read_lines(spark, path + "/a", "id long, lang string"), S.read_csv(spark, path + "/b", "id long, role string")]).select("id", "lang", "role")


@add(
    "S10_S11_quotes",
    f"""WITH {BARS}
    SELECT symbol, ts, round(close - CASE WHEN symbol = 'view' THEN 0.05 ELSE 0.01 END, 6) + 0.0 AS bid, round(close + CASE WHEN symbol = 'view' THEN 0.05 ELSE 0.01 END,
        6) + 0.0 AS ask FROM bars""",
)
def s10(spark, d):
    return S.quotes_from_ohlc(time_bars(ticks(spark, d)), {"view": 0.05}, 0.01).select("symbol", "ts", "bid", "ask")


@add("S11_tick_export", f"""SELECT event_type AS symbol, make_timestamp(2024, 1, 1 + event_id % 28, 10, 0, 0) AS ts, round(round(value, 2) - 0.01, 6) + 0.0 AS bid,
    round(round(value, 2) + 0.01, 6) + 0.0 AS ask, CAST(event_id % 7 AS DOUBLE) AS volume FROM events WHERE event_type IN ('click', 'view')""")
def s11(spark, d):
    """Two exports of different forms in one folder: one with a header and one time column, one without and with two."""
    e, path = read(spark, d, "events"), S.shared(spark)
    day = F.lpad((1 + c("event_id") % 28).cast("string"), 2, "0")
    price = F.round("value", 2)
    cells = [F.round(price - 0.01, 2).cast("string"), F.round(price + 0.01, 2).cast("string"), (c("event_id") % 7).cast("string")]
    named = e.filter("event_type = 'click'").select(F.concat_ws(",", F.concat(F.lit("2024-01-"), day, F.lit("T10:00:00.000Z")), *cells).alias("l"))
    header = spark.createDataFrame([("Gmt time,Bid,Ask,Volume",)], "l string")
    header.unionByName(named).coalesce(1).write.text(path + "/click")  # a file has its header first
    e.filter("event_type = 'view'").select(F.concat_ws(";", F.concat(F.lit("2024.01."), day), F.lit("10:00:00"), *cells)).write.text(path + "/view")
    return S.read_export(spark, [path + "/click", path + "/view"], F.regexp_extract("_file", "/(click|view)/[^/]+$", 1))


@add("S12_depth_range", f"""WITH {TICKS}, w AS (SELECT avg(epoch_us(ts)) AS m FROM ticks)
    SELECT id, round(bid, 6) + 0.0 AS bid, round(ask, 6) + 0.0 AS ask, round((volume + id % 9) / 2.0, 6) + 0.0 AS volume, round((bid + ask) / 2, 6) + 0.0 AS mid,
           round(ask + 0.02, 6) + 0.0 AS second_ask FROM ticks, w WHERE ts >= make_timestamp(CAST(floor(m / 1000000) * 1000000 AS BIGINT))""")
def s12(spark, d):
    """A wide depth table out of the ticks, prices in units of 1e-9; its later half is read."""
    t, path = ticks(spark, d), S.shared(spark)
    level = lambda i: {f"bid_px_{i:02d}": (c("bid") - 0.02 * i) * 1e9, f"ask_px_{i:02d}": (c("ask") + 0.02 * i) * 1e9, f"bid_sz_{i:02d}": c("volume"), f"ask_sz_{i:02d}": c("id") % 9}
    wide = t.select("id", c("ts").alias("ts_event"), *[x.alias(n) for i in (0, 1) for n, x in level(i).items()])
    wide.write.parquet(path)
    start = t.agg(F.avg(F.unix_micros(c("ts").cast("timestamp"))).alias("m")).select(F.timestamp_seconds(F.floor(c("m") / 1000000)).cast("timestamp_ntz").cast("string")).first()[0]
    q = S.depth(spark.read.parquet(path), "ts_event", start, keep=("id",))
    return q.select("id", "bid", "ask", "volume", "mid", c("levels")[1]["ask"].alias("second_ask"))


@add("S15_latest", f"WITH {TICKS} SELECT symbol, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM ticks GROUP BY 1")
def s15(spark, d):
    return ticks(spark, d).groupBy("symbol").agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.max("ts").alias("ts"))


@add("S16_S17_S18_versions", f"WITH {BARS} SELECT symbol, ts, round(close, 6) + 0.0 AS close FROM bars WHERE {IN}")
def s16(spark, d):
    """Two versions of a feature table by month; the newest is read."""
    path, b = S.shared(spark), S.with_parts(time_bars(ticks(spark, d)))
    for version, x in ((1, b.withColumn("close", c("close") * 0)), (2, b)):
        S.write_partitioned(x.withColumn("version", F.lit(version)), path, ["version", "symbol", "year", "month"], ["ts"])
    newest = spark.read.parquet(path).agg(F.max("version")).first()[0]
    return S.between(spark.read.parquet(path).filter(c("version") == newest), *SPAN).select("symbol", "ts", "close")


@add("S19_merge_sorted", "SELECT id, n FROM (SELECT doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT conv_id, length(text) FROM conversations)")
def s19(spark, d):
    path = S.shared(spark)
    a = read(spark, d, "documents").select(c("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    b = read(spark, d, "conversations").select(c("conv_id").alias("id"), F.length("text").cast("long").alias("n"))
    a.unionByName(b).repartitionByRange("id").sortWithinPartitions("id", "n").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@add("S20_audit_lines", "SELECT event_id AS id, event_type AS event FROM events WHERE event_id % 10 <> 0")
def s20(spark, d):
    """An audit log with broken lines."""
    path = S.shared(spark)
    line = F.when(c("event_id") % 10 == 0, F.lit('{"id": broken')).otherwise(F.to_json(F.struct(c("event_id").alias("id"), c("event_type").alias("event"))))
    read(spark, d, "events").select(line.alias("value")).write.text(path)
    return S.read_lines(spark, path, "id long, event string").filter("id is not null")


# streams


def stream_ticks(spark, d):
    return J.parsed(J.as_messages(J.events(spark, d)))


def stateful(spark, d, step, start, names, value=None):
    """Ticks through a step in event order, with state in RocksDB."""
    with state.rocksdb(spark):
        return J.to_files(state.keyed_state(stream_ticks(spark, d), step, start, names, value))


@add("S13_ST1_parse", f"WITH {TICKS} SELECT id, symbol, round(bid, 6) + 0.0 AS bid, round(ask, 6) + 0.0 AS ask FROM ticks")
def st1(spark, d):
    return J.to_files(stream_ticks(spark, d)).select("id", "symbol", "bid", "ask")


CLOSED = "(SELECT max(date_trunc('milliseconds', ts)) FROM ticks) - INTERVAL 30 SECOND"


@add(
    "ST2_ST3_tumbling",
    f"""WITH {TICKS},
    w AS (SELECT symbol, time_bucket(INTERVAL '1 minute', ts) AS start, count(*) AS n, avg(mid) AS m, avg(spread) AS s
        FROM ticks GROUP BY 1, 2)
    SELECT symbol, start, n, round(m, 6) + 0.0 AS mean_mid, round(s, 6) + 0.0 AS mean_spread FROM w WHERE start + INTERVAL 1 MINUTE <= {CLOSED}""",
)
def st2(spark, d):
    return J.to_files(J.windowed(stream_ticks(spark, d), "1 minute")).withColumn("start", c("start").cast("timestamp_ntz"))


@add(
    "ST4_sliding",
    f"""WITH {TICKS},
    x AS (SELECT *, unnest([0, 10, 20, 30, 40, 50]) AS o FROM ticks),
    w AS (SELECT symbol, time_bucket(INTERVAL '10 seconds', ts) - to_seconds(o) AS start, count(*) AS n, avg(mid) AS m, avg(spread) AS s
        FROM x GROUP BY 1, 2)
    SELECT symbol, start, n, round(m, 6) + 0.0 AS mean_mid, round(s, 6) + 0.0 AS mean_spread FROM w WHERE start + INTERVAL 1 MINUTE <= {CLOSED}""",
)
def st4(spark, d):
    return J.to_files(J.windowed(stream_ticks(spark, d), "60 seconds", "10 seconds")).withColumn("start", c("start").cast("timestamp_ntz"))


PASSED = "date_trunc('milliseconds', ts) < " + CLOSED
IN_ORDER = "PARTITION BY symbol ORDER BY ts, id ROWS UNBOUNDED PRECEDING"


@add(
    "ST6_ST12_running_state",
    f"""WITH {TICKS}, x AS (
        SELECT symbol, id, ts, avg(mid) OVER w AS m, coalesce(stddev_samp(mid) OVER w, 0.0) AS s,
               list_reduce(list(mid) OVER (PARTITION BY symbol ORDER BY ts, id ROWS 399 PRECEDING), lambda a, v: a + (v - a) * (2.0 / 21)) AS e
        FROM ticks WINDOW w AS ({IN_ORDER}))
    SELECT symbol, id, round(e, 6) + 0.0 AS ema, round(m + 3.1e-8, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS std FROM x WHERE {PASSED}""",
)
def st6(spark, d):
    out = stateful(spark, d, J.ema_step(20), [0.0] * 4, ["ema", "mean", "std"])
    return out.withColumn("mean", c("mean") + 3.1e-8)  # prices have two digits: off the ties of rounding


@add(
    "ST7_page_hinkley",
    f"""WITH {TICKS}, a AS (SELECT *, mid - avg(mid) OVER w - 0.5 AS dv FROM ticks WINDOW w AS ({IN_ORDER})),
    b AS (SELECT *, sum(dv) OVER w AS s FROM a WINDOW w AS ({IN_ORDER})),
    x AS (SELECT symbol, id, ts, round(s - least(min(s) OVER w, 0.0), 4) + 0.0 AS ph FROM b WINDOW w AS ({IN_ORDER}))
    SELECT symbol, id, ph FROM x WHERE {PASSED}""",
    4,
)
def st7(spark, d):
    return stateful(spark, d, J.page_hinkley_step(0.5), [0.0] * 4, ["ph"])


ERROR = "CAST(mid > 250 AS INT)"


@add(
    "ST7_ddm",
    f"""WITH {TICKS}, a AS (SELECT symbol, id, ts, avg({ERROR}) OVER w AS p, count(*) OVER w AS n FROM ticks WINDOW w AS ({IN_ORDER})),
    b AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM a),
    l AS (SELECT *, arg_min({{'p': p, 's': s}}, p + s) FILTER (n >= 30) OVER w AS least FROM b WINDOW w AS ({IN_ORDER}))
    SELECT symbol, id, CASE WHEN n < 30 THEN 0.0 WHEN p + s > least.p + 3 * least.s THEN 2.0
                            WHEN p + s > least.p + 2 * least.s THEN 1.0 ELSE 0.0 END AS ddm
    FROM l WHERE {PASSED}""",
)
def st7_ddm(spark, d):
    return stateful(spark, d, J.ddm_step(), [0.0] * 4, ["ddm"], c("mid") > 250)


@add(
    "ST7_eddm",
    f"""WITH {TICKS}, a AS (SELECT symbol, id, ts, {ERROR} AS e, row_number() OVER w AS n FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, id)),
    d AS (SELECT symbol, n, n - lag(n, 1, 0) OVER (PARTITION BY symbol ORDER BY n) AS d FROM a WHERE e = 1),
    m AS (SELECT symbol, n, count(*) OVER w AS k, avg(d) OVER w + 2 * stddev_pop(d) OVER w AS reach FROM d WINDOW w AS (PARTITION BY symbol
        ORDER BY n ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT symbol, n, k, reach / max(reach) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING) AS ratio FROM m)
    SELECT a.symbol, a.id, CASE WHEN coalesce(r.k, 0) < 30 THEN 0.0 WHEN ratio < 0.90 THEN 2.0 WHEN ratio < 0.95 THEN 1.0 ELSE 0.0 END AS eddm
    FROM a ASOF LEFT JOIN r ON r.symbol = a.symbol AND r.n <= a.n WHERE {PASSED}""",
)
def st7_eddm(spark, d):
    return stateful(spark, d, J.eddm_step(), [0.0] * 5, ["eddm"], c("mid") > 250)


@add("ST7_adwin_vote", None)
def st7_vote(spark, d):
    return stateful(spark, d, J.vote_step(), [], ["hinkley", "ddm", "eddm", "adwin", "share"], c("mid") > 250)


@add("ST9_S14_latest_sink", f"WITH {TICKS} SELECT symbol, arg_max(id, (ts, id)) AS id FROM ticks GROUP BY 1")
def st9(spark, d):
    t = stream_ticks(spark, d).select("symbol", "ts", "id", F.struct("ts", "id").alias("o"))
    return J.to_latest(t, ["symbol"], "o").select("symbol", "id")


@add("ST10_no_repeats", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1")
def st10(spark, d):
    e = stream_ticks(spark, d)
    twice = e.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    return J.to_files(J.without_repeats(twice)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@add("ST11_news", "SELECT doc_id, " + " OR ".join(f"contains(lower(coalesce(text, '')), '{k}')" for k in HIGH_IMPACT) + " AS high FROM documents")
def st11(spark, d):
    docs = J.table_stream(spark, d, "documents", 1000)
    return J.to_files(J.enriched(docs.select("doc_id", "text"))).select("doc_id", "high")


@add("S3_snapshot_range", f"WITH {TICKS} SELECT id, symbol, ts FROM ticks WHERE {IN} AND symbol IN ('click', 'view')")
def s3_snapshot(spark, d):
    """A snapshot table; of its files only those of two keys and a week are opened."""
    table = Table(spark, S.shared(spark))
    table.append(ticks(spark, d))
    return table.read(keys=["click", "view"], start=SPAN[0], end=SPAN[1]).select("id", "symbol", "ts")


@add("S5_snapshot_refresh", f"WITH {TICKS} SELECT symbol, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids FROM ticks WHERE symbol <> 'error' OR id % 2 = 0 GROUP BY 1")
def s5_snapshot(spark, d):
    """A refresh after one key lost rows, as one commit: files of the other keys are the ones that were there before."""
    table, t = Table(spark, S.shared(spark)), ticks(spark, d)
    table.refresh(t)
    table.refresh(t.filter("symbol <> 'error' or id % 2 = 0"))
    return table.read().groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"))


@add("S16_snapshot_versions", f"WITH {BARS} SELECT symbol, ts, round(close, 6) + 0.0 AS close, 2 AS versions FROM bars WHERE {IN}")
def s16_snapshot(spark, d):
    """Two versions of a feature table; the older one is still read as it was when the newer one is there."""
    table, b = Table(spark, S.shared(spark)), time_bars(ticks(spark, d))
    first = table.append(b)
    table.replace(b.withColumn("close", c("close") * 0), b.select(c("symbol").alias("key")).distinct(), first)
    return table.read(first, start=SPAN[0], end=SPAN[1]).select("symbol", "ts", "close", F.lit(len(table.versions())).alias("versions"))


@add("S14_snapshot_sink", f"WITH {TICKS} SELECT symbol, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids FROM ticks GROUP BY 1")
def s14_snapshot(spark, d):
    """Stream batches appended as snapshots, each of them delivered twice."""
    table = Table(spark, S.shared(spark))
    once = sink(table, "ticks")

    def twice(df, batch_id):
        once(df, batch_id)
        once(df, batch_id)

    stream = stream_ticks(spark, d).withColumn("ts", c("ts").cast("timestamp_ntz"))
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", J.work_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return table.read().groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"))
