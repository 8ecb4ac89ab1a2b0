"""Point-in-time joins without range explosion: both sides in one ordered frame, dealt by key and stretch of time.

A key's rows of one stretch (CELL) are ordered in a task of their own; what was last known before a stretch follows from
one row for each of a key's stretches, so a key with most of the rows is many tasks, and the answer is the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a stretch.
CELL = 86_400


def celled(df: DataFrame, key: list[str], t: str, seconds: int = CELL) -> DataFrame:
    """df with _at, its key and stretch of time as one value (null keys and times are values too)."""
    cell = F.floor(F.unix_micros(F.col(t).cast("timestamp")) / (seconds * 1_000_000))
    return df.withColumn("_at", F.struct(*[F.col(k) for k in key], cell.alias("_cell")))


def last_known(df: DataFrame, key: list[str], order: list[Column], value: str, out: str, ahead: bool = False) -> DataFrame:
    """df (with _at) and out: the last non-null value up to each row in order, or with ahead the first from it on.

    In two passes: inside the stretches, and over one row for each stretch. Ahead is looked back over the rows in reverse: a frame
    that ends with its partition is gone through anew for every row."""
    seen = F.col(value).isNotNull()
    place = F.when(seen, F.struct(*order))
    pick = F.min_by if ahead else F.max_by
    ends = df.groupBy("_at").agg(pick(value, place).alias("_end"))
    by = Window.partitionBy(*[F.col("_at")[k] for k in key]) if key else Window.partitionBy(F.lit(0))
    turned = (lambda o: o.desc()) if ahead else (lambda o: o.asc())
    by = by.orderBy(turned(F.col("_at._cell")))
    carry = F.last("_end", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_at").orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, 0))
    carried = ends.select(F.col("_at").alias("_to"), carry.alias("_carry"))
    inside = df.withColumn("_own_value", own)
    return inside.join(carried, F.col("_at") == F.col("_to"), "left").withColumn(out, F.coalesce("_own_value", "_carry")).drop("_to", "_carry", "_own_value")


def merged(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, values: list[str], last_right: bool) -> DataFrame:
    """The rows of both sides under common columns; _side orders ties so that a right row stands before (or after) equal times."""
    values_struct = F.struct(*[F.col(v) for v in values], F.col(right_ts).alias("_at"))
    kind = right.select(values_struct.alias("_v")).schema["_v"].dataType
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    own_kind = left.select(own.alias("_own")).schema["_own"].dataType
    a = left.select(*key, F.col(left_ts).alias("_t"), F.lit(0 if last_right else 1).alias("_side"), own.alias("_own"), F.lit(None).cast(kind).alias("_v"))
    b = right.select(*key, F.col(right_ts).alias("_t"), F.lit(1 if last_right else 0).alias("_side"), F.lit(None).cast(own_kind).alias("_own"), values_struct.alias("_v"))
    return a.unionByName(b)


def asof(left: DataFrame, right: DataFrame, key: list[str], values: list[str], left_ts: str = "ts", right_ts: str = "ts", tie: Column | None = None, tolerance: str = "", keep_time: str = "", seconds: int = CELL) -> DataFrame:
    """Each left row with the values of the last right row at or before it (J1), null if none or older than tolerance.

    key may be empty: one right series for all. right rows of one time: tie decides, the largest last. keep_time names a column for the
    matched row's time. seconds: how long the stretches are that rows are dealt by."""
    order = [F.col("_t"), F.col("_side")] + ([F.col("_tie")] if tie is not None else [])
    if tie is not None:
        right = right.withColumn("_tie", tie)
    both = merged(left, right, key, left_ts, right_ts, [*values, *(["_tie"] if tie is not None else [])], last_right=False)
    if tie is not None:
        both = both.withColumn("_tie", F.col("_v._tie"))
    found = last_known(celled(both, key, "_t", seconds), key, order, "_v", "_f").filter(F.col("_own").isNotNull())
    ok = F.lit(True) if not tolerance else (F.col("_f._at") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}"))
    more = [F.when(ok, F.col("_f._at")).alias(keep_time)] if keep_time else []
    return found.select("_own.*", *[F.when(ok, F.col(f"_f.{v}")).alias(v) for v in values], *more)


def asof_next(left: DataFrame, right: DataFrame, key: list[str], values: list[str], left_ts: str = "ts", right_ts: str = "ts", keep_time: str = "", seconds: int = CELL) -> DataFrame:
    """Each left row with the values of the first right row at or after it."""
    both = merged(left, right, key, left_ts, right_ts, values, last_right=True)
    found = last_known(celled(both, key, "_t", seconds), key, [F.col("_t"), F.col("_side")], "_v", "_f", ahead=True).filter(F.col("_own").isNotNull())
    return found.select("_own.*", *[F.col(f"_f.{v}").alias(v) for v in values], *([F.col("_f._at").alias(keep_time)] if keep_time else []))


def nearest_events(rows: DataFrame, events: DataFrame, key: list[str], before: str, after: str, seconds: int = CELL) -> DataFrame:
    """rows with the times of the last event at or before each one, and of the first after it: two as-of joins, so no row meets
    more than one event of a side, however dense both are. events: key and ts."""
    tick = F.expr("INTERVAL 1 MICROSECOND")
    one = events.select(*key, F.col("ts").alias("_e")).filter("_e is not null")
    past = asof(rows, one, key, [], right_ts="_e", keep_time=before, seconds=seconds)
    both = asof_next(past, one.withColumn("_e", F.col("_e") - tick), key, [], right_ts="_e", keep_time=after, seconds=seconds)
    return both.withColumn(after, F.col(after) + tick)


def in_event_windows(rows: DataFrame, events: DataFrame, before_min: int, after_min: int, key: list[str] | None = None, seconds: int = CELL) -> DataFrame:
    """Flags near_before and near_after: an event follows within before_min minutes, or came at most after_min ago.

    The nearest event on each side decides. Equal rows all stay; a row without a time is near nothing."""
    both = nearest_events(rows, events, key or [], "_past", "_next", seconds)
    after = F.col("ts") <= F.col("_past") + F.expr(f"INTERVAL {after_min} MINUTES")
    ahead = F.col("ts") >= F.col("_next") - F.expr(f"INTERVAL {before_min} MINUTES")
    flags = {n: F.coalesce(x, F.lit(False)).cast("int") for n, x in (("near_before", ahead), ("near_after", after))}
    return both.select(*rows.columns, *[x.alias(n) for n, x in flags.items()])


def nearness(rows: DataFrame, anchors: DataFrame, within_s: float, most: float, key: list[str] | None = None, name: str = "weight", seconds: int = CELL) -> DataFrame:
    """rows with a weight of 1 far from any anchor, rising evenly to most at one, from within_s seconds on."""
    both = nearest_events(rows, anchors, key or [], "_past", "_next", seconds)
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    away = F.least(micros("ts") - micros("_past"), micros("_next") - micros("ts")) / 1e6
    near = F.when(away <= within_s, 1.0 + (most - 1.0) * (1 - away / within_s))
    return both.select(*rows.columns, F.coalesce(near, F.lit(1.0)).alias(name))


def forward_fill(df: DataFrame, columns: list[str], key: list[str], order: list[str], seconds: int = CELL) -> DataFrame:
    """Nulls of the columns give way to the last value before them; the first of order is a time."""
    out = celled(df, key, order[0], seconds)
    for x in columns:
        out = last_known(out, key, [F.col(o) for o in order], x, x)
    return out.select(*df.columns)


def common_times(df: DataFrame, n: int, key: str = "symbol", value: str = "close") -> DataFrame:
    """The times that all n keys have, with their values by key; of doubles the first counts."""
    first = df.groupBy("ts", key).agg(F.min_by(value, "id").alias("v"))
    return first.groupBy("ts").agg(F.count(F.lit(1)).alias("have"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "v")))).alias("values")).filter(F.col("have") == n)
