"""Readers and writers: tolerant text formats, partitioned stores, incremental refresh."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder or the warehouse."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return f"{top}/store-{uuid.uuid4().hex}"


def time_column(df: DataFrame) -> str:
    """The first column that is a time, by type and then by name."""
    typed = [c for c, t in df.dtypes if t.startswith("timestamp")]
    named = [c for c in df.columns if c.lower() in ("ts", "time", "timestamp", "timestamp_utc", "datetime", "__index_level_0__")]
    if not (found := [*typed, *named]):
        raise ValueError(f"no time column among {df.columns}")
    return found[0]


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows in [start, end), filtered on the raw column so that the scan gets it."""
    t = time_column(df)
    kind = dict(df.dtypes)[t]
    return df.filter((F.col(t) >= F.lit(start).cast(kind)) & (F.col(t) < F.lit(end).cast(kind)))


def with_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """year, month and day to lay out by."""
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})


def write_partitioned(df: DataFrame, path: str, by: list[str], order: list[str], mode: str = "overwrite") -> None:
    """One task for each partition value, rows in order, only touched partitions replaced."""
    laid = df.repartition(*by).sortWithinPartitions(*by, *order)
    laid.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df written to a new shared folder and read again: later steps don't compute it anew."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_partitions(spark: SparkSession, path: str, key: str, stay: set[str]) -> list[str]:
    """Deletes the folders of a store laid out by key whose values are not among stay; returns the values. A listing of folders, not of rows."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(top) if fs.exists(top) else []:
        name = status.getPath().getName()
        value = unquote(name.removeprefix(f"{key}="))
        if name.startswith(f"{key}=") and value not in stay:
            fs.delete(status.getPath(), True)
            gone.append(value)
    return gone


def refresh(source: DataFrame, path: str, manifest: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """Brings a store laid out by key up to date and returns the new manifest (key, rows, hash).

    Keys whose row count or hash changed since the manifest are written anew, keys that the source no longer has are
    deleted, the rest isn't touched. The hash is a sum over rows, so repeated rows count each time. A null key is a key."""
    rows = F.sum(F.xxhash64(*source.columns).cast("decimal(38,0)")).cast("string")
    now = kept(source.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), rows.alias("hash")))
    if manifest is None:
        changed = now
    else:
        old = manifest.select(F.col(key).alias("_key"), F.col("rows").alias("_rows"), F.col("hash").alias("_hash"))
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("rows") == F.col("_rows")) & (F.col("hash") == F.col("_hash"))
        changed = now.join(old, same, "left_anti")
    changed = changed.select(F.col(key).alias("_key"))
    write_partitioned(source.join(changed, F.col(key).eqNullSafe(F.col("_key")), "left_semi"), path, [key], order)
    missing = "__HIVE_DEFAULT_PARTITION__"
    stay = {missing if r[0] is None else r[0] for r in now.select(F.col(key).cast("string")).collect()}  # as many as there are folders
    drop_partitions(source.sparkSession, path, key, stay)
    return now


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't fit the schema are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def diagonal(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns differ; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


#: Names that exports give their columns, by what they are; and the columns of files without a header, by how many there are (fixed values).
NAMES = {
    "date": ("date", "day"),
    "time": ("time", "hour"),
    "datetime": ("datetime", "timestamp", "timestamp_utc", "ts", "gmt time", "date/time", "time (utc)", "ts_event"),
    "bid": ("bid", "bid_px_00"),
    "ask": ("ask", "ask_px_00"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c", "adjusted_close"),
    "volume": ("volume", "vol", "tickvol", "tick volume", "v"),
}
HEADLESS = {4: ("datetime", "bid", "ask", "volume"), 5: ("date", "time", "bid", "ask", "volume"), 6: ("datetime", "open", "high", "low", "close", "volume"), 7: ("date", "time", "open", "high", "low", "close", "volume")}
#: Date forms of exports, tried in turn.
FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyyMMdd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm", "yyyyMMdd HH:mm", "yyyy-MM-dd", "yyyy.MM.dd", "yyyyMMdd")


def export_format(first: str) -> dict:
    """What the first line of an export tells: sep, header (whether it is one), and columns, what each of them is (None: something else)."""
    sep = max(";\t,", key=first.count)
    cells = [x.strip().strip('"').strip("<>").lower() for x in first.split(sep)]
    known = {n: what for what, names in NAMES.items() for n in names}
    columns = [known.get(x) for x in cells]
    if "bid" in columns or "close" in columns:
        return {"sep": sep, "header": True, "columns": columns}
    if len(cells) not in HEADLESS:
        raise ValueError(f"an export of {len(cells)} columns without names: {first!r}")
    return {"sep": sep, "header": False, "columns": list(HEADLESS[len(cells)])}


def first_lines(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """The first line of each file under path, by file; a row for each file comes to the driver."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("nth"))
    found = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "nth").alias("first"))
    file = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))  # as a path, not as a URI
    return {r[0]: r[1] for r in found.select(file, "first").collect()}


EXPORT = "symbol string, ts timestamp_ntz, bid double, ask double, volume double"


def read_export(spark: SparkSession, path: str | list[str], symbol: str | Column, half_spread: float = 0.0) -> DataFrame:
    """symbol, ts, bid, ask, volume from tick or bar exports of any of the known forms.

    The form of each file is told from its first line, so one folder may hold several; files of one form are read together, each of them in as
    many tasks as it is long. symbol: a name for all, or a column made of _file, the file's path. Bars get a bid and an ask around their
    close, half_spread away. Rows without a time or a price are left out."""
    forms: dict[tuple, list[str]] = {}
    for file, first in sorted(first_lines(spark, path).items()):
        form = export_format(first)
        forms.setdefault((form["sep"], form["header"], tuple(form["columns"])), []).append(file)
    out = spark.createDataFrame([], EXPORT)
    for (sep, header, columns), files in forms.items():
        out = out.unionByName(exported(spark, files, sep, header, columns, symbol, half_spread))
    return out


def exported(spark: SparkSession, files: list[str], sep: str, header: bool, columns: tuple[str | None, ...], symbol: str | Column, half_spread: float) -> DataFrame:
    """The rows of files that have one form."""
    names = [f"_{i}" for i in range(len(columns))]
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in files]  # a path is taken for a pattern
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(literal, sep=sep, header=header, mode="PERMISSIVE", enforceSchema=True)
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    at = {what: F.trim(F.col(n)) for n, what in zip(names, columns) if what}
    text = at["datetime"] if "datetime" in at else F.concat_ws(" ", at["date"], at.get("time", F.lit(None)))
    text = F.regexp_replace(F.regexp_replace(text, "(\\d)T(\\d)", "$1 $2"), r"(\.\d+)?( ?(Z|UTC|GMT))?$", "") if "datetime" in at else text
    clean = F.regexp_replace(text, r"(\d\d:\d\d:\d\d)[.,]\d+$", "$1")
    ts = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)).cast("timestamp_ntz") for f in FORMS])
    number = lambda what: at[what].try_cast("double")
    bid, ask = (number("bid"), number("ask")) if "bid" in at else (number("close") - half_spread, number("close") + half_spread)
    volume = number("volume") if "volume" in at else F.lit(None).cast("double")
    named = F.lit(symbol) if isinstance(symbol, str) else symbol
    out = rows.select(named.alias("symbol"), ts.alias("ts"), bid.alias("bid"), ask.alias("ask"), volume.alias("volume"))
    return out.filter("ts is not null and bid is not null and ask is not null")


def price_scale(df: DataFrame, column: str = "bid_px_00") -> float:
    """1e9 if a table's prices are in units of 1e-9 (half of them or more are above 10,000 in size), 1 otherwise."""
    middle = df.agg(F.percentile_approx(F.abs(column), 0.5)).first()[0]
    return 1e9 if middle is not None and middle > 10_000 else 1.0


def depth(df: DataFrame, ts: str, start: str | None = None, end: str | None = None, inverted: bool = False, scale: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Quotes and levels from a market-by-price table with wide columns bid_px_00, bid_sz_00, ask_px_00 and so on.

    The columns keep, ts, bid, ask, volume (mean size of the first level), mid, spread, and levels, an array with price and size of
    both sides for each level that the table has. scale: what prices are divided by, told from the whole table if not given, so that
    small and negative prices are scaled like the others; inverted: quotes of the other currency. Only the range
    [start, end] is read."""
    n = sum(f"bid_px_{i:02d}" in df.columns for i in range(100))
    scale = price_scale(df) if scale is None else scale
    t = F.col(ts)
    if start:
        df = df.filter(t >= F.lit(start).cast(dict(df.dtypes)[ts]))
    if end:
        df = df.filter(t <= F.lit(end).cast(dict(df.dtypes)[ts]))
    price = lambda side, i: F.col(f"{side}_px_{i:02d}") / scale
    level = lambda i: F.struct(*[x.cast("double").alias(n) for s in ("bid", "ask") for x, n in ((price(s, i), f"{s}"), (F.col(f"{s}_sz_{i:02d}"), f"{s}_size"))])
    bid, ask = price("bid", 0), price("ask", 0)
    if inverted:
        df = df.filter((F.col("bid_px_00") > 1e-12) & (F.col("ask_px_00") > 1e-12))
        bid, ask = 1 / ask, 1 / bid
    volume = (F.col("bid_sz_00") + F.col("ask_sz_00")) / 2.0
    out = df.select(*keep, t.alias("ts"), bid.alias("bid"), ask.alias("ask"), volume.alias("volume"), F.array(*map(level, range(n))).alias("levels"))
    return out.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def quotes_from_ohlc(df: DataFrame, half_spread: dict[str, float], default: float) -> DataFrame:
    """Bid and ask around a close, by a half spread for each symbol."""
    table = F.create_map(*[x for k, v in half_spread.items() for x in (F.lit(k), F.lit(v))])
    half = F.coalesce(table[F.col("symbol")], F.lit(default))
    return df.withColumns({"bid": F.col("close") - half, "ask": F.col("close") + half})
