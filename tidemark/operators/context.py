"""Indicators that need more than a symbol's own bars: higher time frames, other symbols, releases, positions, arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Roll, lag, layers, log_return, series
from tidemark.operators.asof import asof


def c(name: str) -> Column:
    return F.col(name)


EPS = 1e-9


def higher_frame(bars: DataFrame, every: str, shift: str = "1 microsecond") -> DataFrame:
    """Completed bars of a longer step, closed and named on the right, each with its measures lagged by one bar, at every row."""
    at = F.window(c("ts") - F.expr(f"INTERVAL {shift}"), every).end
    up = bars.groupBy("symbol", at.alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    r14, r20, before = Roll(14, 3), Roll(20, 3), lag("close")
    gain, loss = (F.when(c("_d").isNotNull(), F.greatest(x, F.lit(0.0))) for x in (c("_d"), -c("_d")))
    vol = F.when(c("volume") == 0, 1.0).otherwise(c("volume"))
    up = layers(
        up,
        {"_tr": F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before)), "_d": c("close") - before, "_v": vol},
        {"_atr": r14.avg(c("_tr")), "_vwap": r20.sum((c("high") + c("low") + c("close")) / 3 * c("_v")) / (r20.sum(c("_v")) + EPS)},
        {
            "ret": F.log("close") - F.log(before), "rsi": 100 - 100 / (1 + Roll(14, 5).avg(gain) / (Roll(14, 5).avg(loss) + EPS)), "atr": c("_atr"),
            "trend_slope": (c("close") - lag("close", 3)) / (c("_atr") + EPS), "vwap_distance": (c("close") - c("_vwap")) / (c("_atr") + EPS), "vol_regime": c("_atr") / (Roll(24, 5).quantile(c("_atr"), 0.5) + EPS),
        },
    )
    names = ["ret", "rsi", "atr", "trend_slope", "vwap_distance", "vol_regime"]
    lagged = up.select("symbol", "ts", *[F.coalesce(lag(n), F.lit(0.0)).alias(f"htf_{n}") for n in names])
    out = asof(bars.select("symbol", "ts"), lagged, ["symbol"], [f"htf_{n}" for n in names])
    return out.fillna(0.0)


def cross_asset(returns: DataFrame, other: str, n: int = 60, lags: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Another symbol's return at the same times, its lags, and rolling correlation and beta with it."""
    r = Roll(n)
    theirs = returns.filter(c("symbol") == other).select("ts", c("r").alias("x"))
    j = returns.filter(c("symbol") != other).join(theirs, "ts")
    var = F.pow(r.std(c("x")), 2)
    return j.withColumns({f"x_lag_{k}": lag("x", k) for k in lags} | {"corr": r.corr(c("r"), c("x")), "beta": r.cov(c("r"), c("x")) / (var + 1e-12)})


def pair_correlations(returns: DataFrame, n: int = 60, wide: int = 60) -> DataFrame:
    """By time: mean and spread of all pairs' rolling correlations, a stand-in for the leading share of variance, and breaks."""
    a = returns.select(c("symbol").alias("a"), "ts", c("r").alias("x"))
    b = returns.select(c("symbol").alias("b"), "ts", c("r").alias("y"))
    p = a.join(b, "ts").filter("a < b").withColumn("symbol", F.concat_ws("/", "a", "b"))
    k = p.withColumn("k", Roll(n, n // 2).corr(c("x"), c("y")))
    names = returns.agg(F.countDistinct("symbol").alias("m"))
    day = k.groupBy("ts").agg(F.avg("k").alias("corr_avg"), F.coalesce(F.stddev_samp("k"), F.lit(0.0)).alias("corr_dispersion")).join(F.broadcast(names), F.lit(True))
    top = F.least(F.abs("corr_avg"), F.lit(0.99))
    z = Roll(wide, key=(), order=("ts",))
    day = day.withColumn("corr_eigenratio", (1 + (c("m") - 1) * top) / F.greatest(1 - top, F.lit(1e-6)))
    day = day.withColumn("corr_zscore", (c("corr_avg") - z.avg(c("corr_avg"))) / (z.std(c("corr_avg")) + EPS))
    return day.withColumn("corr_break", (F.abs("corr_zscore") > 2).cast("int")).drop("m")


def lead_lag(returns: DataFrame, most: int = 3) -> DataFrame:
    """For each ordered pair the lag at which the first symbol's return goes best with the second's later one."""
    a = returns.select(c("symbol").alias("a"), *[lag("r", k).alias(f"x{k}") for k in range(1, most + 1)], "ts")
    b = returns.select(c("symbol").alias("b"), "ts", c("r").alias("y"))
    j = a.join(b, "ts").filter("a <> b")
    stats = j.groupBy("a", "b").agg(*[F.corr(f"x{k}", "y").alias(f"k{k}") for k in range(1, most + 1)])
    best = F.array_max(F.array(*[F.struct(F.abs(c(f"k{k}")).alias("strength"), F.lit(-k).alias("neg"), c(f"k{k}").alias("corr")) for k in range(1, most + 1)]))
    return stats.withColumn("best", best).select("a", "b", (-c("best.neg")).alias("lag"), c("best.corr").alias("corr"))


def lead_lag_degrees(network: DataFrame, least: float) -> DataFrame:
    """symbol, degrees in and out of links of at least that strength, strongest links, and the network's density."""
    e = network.withColumn("s", F.abs("corr"))
    on = (c("s") >= least).cast("int")
    out = e.groupBy(c("a").alias("symbol")).agg(F.sum(on).alias("outdegree"), F.max("s").alias("lead_corr"))
    into = e.groupBy(c("b").alias("symbol")).agg(F.sum(on).alias("indegree"), F.max("s").alias("follow_corr"))
    return out.join(into, "symbol").join(F.broadcast(e.agg(F.avg(on).alias("density"))))


def calendar(rows: DataFrame, releases: DataFrame, near: float, most: float = 1440.0, wait: float = 1.0, widest: float = 5.0, unknown: float = 0.0) -> DataFrame:
    """rows with since_last and to_next (minutes, most at the utmost), release_flag (one is within near) and surprise.

    releases: ts, actual, forecast, prior, one row for each time; one without a time counts for none. The surprise is known wait minutes
    after its release; it is unknown before the first one, and where a number of the last one is missing or its prior is zero."""
    from tidemark.operators.asof import asof, asof_next

    one = releases.select(c("ts").alias("_e"), "actual", "forecast", "prior").filter("_e is not null")
    past = asof(rows, one, [], ["actual", "forecast", "prior"], right_ts="_e", keep_time="_last")
    both = asof_next(past, one.select((c("_e") - F.expr("INTERVAL 1 MICROSECOND")).alias("_e")), [], [], right_ts="_e", keep_time="_next")
    minutes = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 6e7
    held = lambda x: F.least(F.coalesce(x, F.lit(most)), F.lit(most))
    nxt = c("_next") + F.expr("INTERVAL 1 MICROSECOND")
    both = both.withColumns({"since_last": held(minutes(c("ts"), c("_last"))), "to_next": held(minutes(nxt, c("ts")))})
    moved = (c("actual") - c("forecast")) / F.when(F.abs("prior") > 1e-9, c("prior"))
    moved = F.when(moved.isNotNull(), F.greatest(F.least(moved, F.lit(widest)), F.lit(-widest))).otherwise(F.lit(unknown))  # least and greatest pass over nulls
    flags = {"release_flag": ((c("since_last") <= near) | (c("to_next") <= near)).cast("int"), "surprise": F.when(c("since_last") >= wait, moved).otherwise(0.0)}
    return both.withColumns(flags).drop("_last", "_next", "actual", "forecast", "prior")


def slope(long: DataFrame, short: DataFrame, value: str) -> DataFrame:
    """ts and slope: the long series less the last known value of the short one."""
    from tidemark.operators.asof import asof

    other = short.select("ts", c(value).alias("_short"))
    return asof(long, other, [], ["_short"]).select("ts", (c(value) - c("_short")).alias("slope"))


def relative(returns: DataFrame, n: int = 20) -> DataFrame:
    """Momentum and volatility of a symbol against all at the same time, and how far symbols spread."""
    r = Roll(n)
    own = returns.withColumns({"mom": r.sum(c("r")), "vol": r.std(c("r"))})
    every = Window.partitionBy("ts")
    return own.withColumns(
        {"rel_momentum": c("mom") - F.avg("mom").over(every), "vol_share": c("vol") / (F.sum("vol").over(every) + EPS), "dispersion": F.stddev_samp("r").over(every)}
    )


def positioning(weekly: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Net positions with 4-week momentum and 52-week z-score, known at each row from the last report."""
    r = Roll(52, key=tuple(key))
    w = weekly.withColumns({"mom_4w": c("net") - lag("net", 4, key=tuple(key)), "z_52w": (c("net") - r.avg(c("net"))) / (r.std(c("net")) + EPS)})
    out = asof(rows, w, key, ["net", "mom_4w", "z_52w"])
    return out.fillna(0.0, ["net", "mom_4w", "z_52w"]).withColumn("extreme", F.when(c("z_52w") > 2, 1).when(c("z_52w") < -2, -1).otherwise(0))


def decayed(df: DataFrame, x: str, per_hour: float) -> DataFrame:
    """The last non-zero value, fading with the hours since."""
    seen = F.last(F.when(c(x) != 0, F.struct(c("ts").alias("t"), c(x).alias("v"))), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    hours = (F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(c("_s.t").cast("timestamp"))) / 3.6e9
    return df.withColumn("_s", seen).withColumn("decayed", F.coalesce(c("_s.v") * F.exp(-per_hour * hours), F.lit(0.0))).drop("_s")


def depth(df: DataFrame, bids: str, asks: str, levels: int) -> DataFrame:
    """Depth, imbalance, walls and microprice from arrays of sizes by level."""
    total = lambda a: F.aggregate(F.slice(a, 1, levels), F.lit(0.0), lambda s, v: s + v.cast("double"))
    df = df.withColumns({"bid_depth": total(bids), "ask_depth": total(asks)})
    wall = lambda a, t: F.exists(F.slice(a, 1, levels), lambda v: v > 3 * c(t) / levels).cast("int")
    b0, a0 = (F.element_at(x, 1).cast("double") for x in (bids, asks))
    return df.withColumns({"imbalance": (c("bid_depth") - c("ask_depth")) / (c("bid_depth") + c("ask_depth") + EPS), "bid_wall": wall(bids, "bid_depth"), "ask_wall": wall(asks, "ask_depth"), "micro_weight": a0 / (a0 + b0 + EPS)})


def hurst(df: DataFrame, x: str, n: int = 64, step: int = 8, lags: tuple[int, ...] = (8, 16, 32)) -> DataFrame:
    """Hurst exponent by rescaled ranges on every step-th row's last n values: slope of log range over log length.

    Each row's window becomes (length, chunk) rows; all windows of all symbols are one grouped aggregate."""
    w = Roll(n).window
    at = df.withColumns({"_i": F.row_number().over(series()), "_w": F.collect_list(x).over(w)}).filter((F.size("_w") == n) & (c("_i") % step == 0))

    def cut(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n // k - 1)), lambda j: F.struct(F.lit(k).alias("k"), F.slice("_w", j * k + 1, F.lit(k)).alias("v")))

    chunks = F.flatten(F.array(*map(cut, lags)))
    rows = at.select("symbol", "ts", F.explode(chunks).alias("ch")).select("symbol", "ts", c("ch.k").alias("k"), c("ch.v").alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, v: s + v) / c("k")
    rows = rows.withColumn("m", mean)
    rows = rows.withColumn("sd", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + (v - c("m")) * (v - c("m"))) / c("k")))
    first = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"))
    walk = F.aggregate("v", first, lambda a, v: F.struct((a.s + v - c("m")).alias("s"), F.greatest(a.hi, a.s + v - c("m")).alias("hi"), F.least(a.lo, a.s + v - c("m")).alias("lo")))
    rows = rows.withColumn("walk", walk).filter("sd > 1e-12").withColumn("rs", (c("walk.hi") - c("walk.lo")) / c("sd"))
    by_lag = rows.groupBy("symbol", "ts", "k").agg(F.avg("rs").alias("rs"))
    return by_lag.groupBy("symbol", "ts").agg(F.regr_slope(F.log("rs"), F.log("k")).alias("hurst"))


def no_trade(df: DataFrame, n: int = 60) -> DataFrame:
    """The share of range, spread and trend strength that stand beyond the quantiles of the n rows before."""
    before = Roll(n, 20, skip=1)
    high = lambda x: F.coalesce((c(x) > before.quantile(c(x), 0.9)).cast("int"), F.lit(0))
    low = F.coalesce((c("adx_14") < before.quantile(c("adx_14"), 0.1)).cast("int"), F.lit(0))
    return df.withColumn("no_trade", (high("atr_6") + high("spread") + low) / 3.0)


def vol_state(df: DataFrame, n: int = 60) -> DataFrame:
    """Volatility state 0 to 2 by rolling nearest quantiles, and trend quality."""
    r = Roll(n)
    df = layers(df, {"_r": log_return()}, {"_v": Roll(20).std(c("_r"))}, {"_lo": r.nearest(c("_v"), 0.25), "_hi": r.nearest(c("_v"), 0.75)})
    state = F.when(c("_hi").isNull(), None).when(c("_v") > c("_hi"), 2).when(c("_v") < c("_lo"), 0).otherwise(1)
    return df.withColumns({"vol_state": state, "trend_quality": F.abs(Roll(20).sum(c("_r"))) / (Roll(20).sum(F.abs(c("_r"))) + EPS)}).drop("_r", "_v", "_lo", "_hi")


def products(df: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Products of named columns, from a table of (a, b, name)."""
    return df.withColumns({name: c(a) * c(b) for a, b, name in pairs})


def add_all(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)
