"""Cleaning of ticks, bars and text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Roll, lag, series
from tidemark.operators.asof import celled, last_known
from tidemark.operators.bars import in_buckets
from tidemark.operators.stats import with_quantiles

c = F.col

#: Local trading hours of the three sessions (fixed values): zone, open and close in minutes of the day.
SESSIONS = {"tokyo": ("Asia/Tokyo", 540, 1080), "london": ("Europe/London", 480, 990), "new_york": ("America/New_York", 570, 960)}
#: Spread cost by session, and the unit suffixes of reported figures (fixed values).
SESSION_COST = {"asia": 1.2, "london": 0.9, "ny": 0.9, "asia_london": 1.0, "london_ny": 0.85, "off": 1.5}
UNITS = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12, "%": 1e-2}

NAMES = {"timestamp": "ts", "time": "ts", "datetime": "ts", "timestamp_utc": "ts", "pair": "symbol", "id": "id"}


def standardise(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Canonical names and types, mid and spread from the quotes, rows without a positive spread dropped."""
    for a, b in names.items():
        df = df.withColumnRenamed(a, b)
    df = df.withColumns({"bid": c("bid").cast("double"), "ask": c("ask").cast("double")})
    return df.withColumns({"mid": (c("bid") + c("ask")) / 2, "spread": c("ask") - c("bid")}).filter("spread > 0")


def enforce(df: DataFrame, key: list[str], tie: str) -> DataFrame:
    """No crossed quotes, and one row for each key: the first by tie."""
    w = Window.partitionBy(*key).orderBy(tie)
    return df.filter("bid < ask").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def bad_ticks(df: DataFrame, window: int = 20, z: float = 3.0, mad_z: float = 6.0, wide: float = 8.0, size: int = 100_000) -> DataFrame:
    """Prices far from the rows before them, unless the spread is wide too, give way to the median before.

    The statistics leave the row itself out; a wide spread marks a quote that may be true. A symbol's ticks are dealt out in
    buckets of so many rows (size), each with the rows before it that its first frames need."""
    order = ("ts", "id")
    df = in_buckets(df, 2 * window + 1, size, order)
    before = Roll(window, 5, skip=1, key=("symbol", "bucket"), order=order)
    x = c("mid")
    df = df.withColumns({"_m": before.avg(x), "_s": before.std(x), "_med": before.quantile(x, 0.5), "_sp": before.quantile(c("spread"), 0.5)})
    df = df.withColumn("_dev", F.abs(x - c("_med")))
    df = df.withColumn("_mad", before.quantile(c("_dev"), 0.5))
    far = (F.abs(x - c("_m")) / (c("_s") + 1e-9) > z) | (0.6745 * c("_dev") / (c("_mad") + 1e-9) > mad_z)
    bad = F.coalesce(far & ~(c("spread") > wide * c("_sp")), F.lit(False))
    return df.withColumn("is_bad", bad).withColumn("mid", F.when(c("is_bad"), c("_med")).otherwise(x)).withColumns({"bid": c("mid") - c("spread") / 2, "ask": c("mid") + c("spread") / 2}).filter(~c("halo")).drop("_m", "_s", "_med", "_sp", "_dev", "_mad", "bucket", "halo")


def in_market(ts: str = "ts") -> Column:
    """Open from Sunday 22:00 to Friday 22:00 (C4)."""
    d, h = F.weekday(ts), F.hour(ts)
    return ~((d == 5) | ((d == 4) & (h >= 22)) | ((d == 6) & (h < 22)))


def without_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows whose date is not in days (C5, C6); Spark broadcasts days if they are few."""
    return df.join(days.select(c("day").alias("_day")), F.to_date("ts") == c("_day"), "left_anti")


def thin_days(df: DataFrame, share: float = 0.8) -> DataFrame:
    """The days whose volume is under share of the median day's."""
    days = df.groupBy(F.to_date("ts").alias("day")).agg(F.sum("volume").alias("v"))
    median = days.agg(F.percentile("v", 0.5).alias("m"))
    return days.join(F.broadcast(median), c("v") < share * c("m")).select("day")


def outside_ranges(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows in none of the (symbol, start, end) ranges (C8, G11): days that a range touches make the join an equal one."""
    days = ranges.select(c("symbol").alias("_sym"), c("start").alias("_a"), c("end").alias("_b"), F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_day"))
    return df.join(days, (c("symbol") == c("_sym")) & (F.to_date("ts") == c("_day")) & (c("ts") >= c("_a")) & (c("ts") <= c("_b")), "left_anti")


def gaps(df: DataFrame, every_s: int) -> DataFrame:
    """By symbol: gaps wider than the step, rows missing in them, the longest in seconds."""
    step = (F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(lag("ts").cast("timestamp"))) / 1e6
    wide = c("_d") > every_s
    return df.withColumn("_d", step).groupBy("symbol").agg(
        F.count_if(wide).alias("gaps"),
        F.coalesce(F.sum(F.when(wide, F.floor(c("_d") / every_s) - 1)), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.max(F.when(wide, c("_d"))), F.lit(0.0)).alias("longest_s"))


def grid_of(span: DataFrame, step_s: int, name: str, many: int = 1000) -> DataFrame:
    """symbol and name: the times from a to b, step_s seconds apart, by way of rows of many times each; no row holds a whole grid."""
    micros = lambda x: F.unix_micros(c(x).cast("timestamp"))
    steps = F.floor((micros("b") - micros("a")) / (step_s * 1_000_000))
    parts = span.withColumn("_n", steps).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(c("_n") / many))))
    nth = F.explode(F.sequence(c("_j") * many, F.least(c("_n"), c("_j") * many + many - 1)))
    return parts.withColumn("_k", nth).select("symbol", (c("a") + F.make_dt_interval(secs=(c("_k") * step_s).cast("decimal(18,6)"))).alias(name))


def fill_grid(bars: DataFrame, every: str, every_s: int, limit_s: int, policy: str = "ffill") -> DataFrame:
    """Bars on a regular grid: a missing close is the last one, or on the line to the next, up to limit_s after a bar."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = grid_of(span, every_s, "ts")
    full = grid.join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    seen = F.when(c("close").isNotNull(), F.struct(c("ts").alias("t"), c("close").alias("x")))
    full = celled(full.withColumn("_seen", seen), ["symbol"], "ts")
    full = last_known(full, ["symbol"], [c("ts")], "_seen", "_p")
    full = last_known(full, ["symbol"], [c("ts")], "_seen", "_n", ahead=True)
    sec = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    age = sec(c("_p.t"), c("ts"))
    line = c("_p.x") + (c("_n.x") - c("_p.x")) * age / F.nullif(sec(c("_p.t"), c("_n.t")), F.lit(0.0))
    value = c("_p.x") if policy == "ffill" else F.coalesce(line, c("_p.x"))
    return full.withColumns({"filled": c("close").isNull() & (age <= limit_s), "close": F.when(c("close").isNotNull(), c("close")).when(age <= limit_s, value)}).select("symbol", "ts", "close", "filled")


def fixed_sessions(df: DataFrame) -> DataFrame:
    """Session by UTC hour, and whether two overlap (C11)."""
    h = F.hour("ts")
    asia, london, ny = (h >= 0) & (h < 8), (h >= 7) & (h < 16), (h >= 12) & (h < 21)
    label = F.when(london & ny, "london_ny").when(asia & london, "asia_london").when(london, "london").when(ny, "ny").when(asia, "asia").otherwise("off")
    return df.withColumns({"session": label, "overlap": (london & ny) | (asia & london)})


def local_sessions(df: DataFrame) -> DataFrame:
    """Flags by each market's own clock, summer time included."""
    flags = {}
    for name, (zone, a, b) in SESSIONS.items():
        local = F.from_utc_timestamp(c("ts").cast("timestamp"), zone)
        minute = F.hour(local) * 60 + F.minute(local)
        flags[f"in_{name}"] = ((minute >= a) & (minute < b) & (F.weekday(local) < 5)).cast("int")
    return df.withColumns(flags)


def sanitise(df: DataFrame, columns: list[str], key: list[str], order: list[str], bound: float = 1e6) -> DataFrame:
    """Infinite and undefined become missing, then the last value, then zero, within bounds (C14)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ok = {x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), c(x)) for x in columns}
    filled = {x: F.greatest(F.least(F.coalesce(F.last(x, ignorenulls=True).over(w), F.lit(0.0)), F.lit(bound)), F.lit(-bound)) for x in columns}
    return df.withColumns(ok).withColumns(filled)


def staleness(df: DataFrame, column: str) -> DataFrame:
    """Whether a value is missing, whether none was seen yet, and rows since the last."""
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    row = F.row_number().over(series())
    df = df.withColumn("_row", row).withColumn("_last", F.max(F.when(c(column).isNotNull(), c("_row"))).over(w))
    return df.withColumns({f"{column}_missing": c(column).isNull().cast("int"), f"{column}_never_seen": c("_last").isNull().cast("int"), f"{column}_age": (c("_row") - c("_last")).cast("int")}).drop("_row", "_last")


def robust_clip(df: DataFrame, column: str, key: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values within their key's quantiles."""
    bounded = with_quantiles(df, column, key, {"_a": low, "_b": high})
    return bounded.withColumn(column, F.least(F.greatest(c(column), c("_a")), c("_b"))).drop("_a", "_b")


def unit_number(text: Column) -> Column:
    """A figure with a unit: "148K", "0.3%", "-5.9B"; null if it is none."""
    number = F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+)\s*([KMBT%]?)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*[-+]?[0-9]*\.?[0-9]+\s*([KMBT%]?)\s*$", 1)
    scale = F.lit(1.0)
    for suffix, x in UNITS.items():
        scale = F.when(unit == suffix, F.lit(x)).otherwise(scale)
    return number * scale


def cleaned_number(text: Column) -> Column:
    """What is left of a figure without all but digits, point and sign."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def missing_hours(df: DataFrame) -> DataFrame:
    """Hours of a symbol's span with no row, as runs: start, end, hours (C26); months work alike."""
    have = df.select("symbol", F.date_trunc("hour", c("ts").cast("timestamp")).alias("h")).distinct()
    span = have.groupBy("symbol").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    grid = grid_of(span, 3600, "h")
    gone = grid.join(have, ["symbol", "h"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("h"))
    runs = gone.withColumn("_g", F.unix_timestamp("h") / 3600 - nth)
    return runs.groupBy("symbol", "_g").agg(F.min("h").cast("timestamp_ntz").alias("start"), F.max("h").cast("timestamp_ntz").alias("end"), F.count(F.lit(1)).alias("hours")).drop("_g")


def sanity(df: DataFrame, low: float, high: float) -> DataFrame:
    """Counts of impossible or doubtful rows by symbol."""
    n = lambda x: F.count_if(x)
    doubled = df.groupBy("symbol", "ts").count().groupBy("symbol").agg(F.sum(c("count") - 1).alias("duplicates"))
    counts = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), n(~c("mid").between(low, high)).alias("out_of_range"), n(c("bid") >= c("ask")).alias("crossed"),
        n(c("spread") > 0.04).alias("wide"), n(c("volume").isNull()).alias("no_volume"), F.avg("spread").alias("avg_spread"), F.max("spread").alias("max_spread"))
    return counts.join(doubled, "symbol")


def quality_reasons(df: DataFrame, thin: DataFrame) -> DataFrame:
    """Each bar with the reasons against it, and whether there are none (C17)."""
    six = Roll(60, 20).quantile(c("spread"), 0.5)
    df = df.withColumn("_day", F.to_date("ts")).join(thin.select(c("day").alias("_day"), F.lit(True).alias("_thin")), "_day", "left")
    reasons = {"bad_weekend": ~in_market(), "bad_thin": c("_thin").isNotNull(), "bad_dead": (c("high") == c("low")) & (c("volume") < 1), "bad_spread": F.coalesce(c("spread") > 1.5 * six, F.lit(False))}
    df = df.withColumns({k: v.cast("int") for k, v in reasons.items()})
    return df.withColumn("row_ok", (sum(c(k) for k in reasons) == 0).cast("int")).drop("_day", "_thin")
