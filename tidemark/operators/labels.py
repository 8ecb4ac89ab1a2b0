"""Forward-looking labels: each row's next prices as an array over a bounded frame, and folds over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Roll, following, lead


def c(name: str) -> Column:
    return F.col(name)


def first_hit(path: str, test) -> Column:
    """The place, from 0, of the first value for which test holds; null if none."""
    return F.nullif(F.array_position(F.transform(path, test), True), F.lit(0)) - 1


def triple_barrier(df: DataFrame, horizon: int = 10, delay: int = 1, profit: float = 1.2, stop: float = 0.8, atr: str = "atr_6") -> DataFrame:
    """Which barrier a long and a short trade, entered delay bars on, meet first within horizon bars (L1).

    Long trades enter at the ask and leave at the bid; on a path value that meets both, profit counts. tb_label is the
    side that won, 0 if none or both did; rows without a whole horizon have no label."""
    ahead = following(delay + 1, delay + horizon)
    df = df.withColumns(
        {"_bid": F.collect_list("bid_close").over(ahead), "_ask": F.collect_list("ask_close").over(ahead), "_el": lead("ask_close", delay), "_es": lead("bid_close", delay), "_a": lead(atr, delay)}
    )
    whole = (F.size("_bid") == horizon) & c("_a").isNotNull()
    at = {
        "_lp": first_hit("_bid", lambda p: p >= c("_el") + profit * c("_a")),
        "_ls": first_hit("_bid", lambda p: p <= c("_el") - stop * c("_a")),
        "_sp": first_hit("_ask", lambda p: p <= c("_es") - profit * c("_a")),
        "_ss": first_hit("_ask", lambda p: p >= c("_es") + stop * c("_a")),
    }
    df = df.withColumns(at)

    def outcome(p: Column, s: Column) -> Column:
        return F.when(~whole, None).when(p.isNotNull() & (s.isNull() | (p <= s)), 1).when(s.isNotNull(), -1).otherwise(0)

    df = df.withColumns({"long_outcome": outcome(c("_lp"), c("_ls")), "short_outcome": outcome(c("_sp"), c("_ss"))})
    for side, p, s in (("long", "_lp", "_ls"), ("short", "_sp", "_ss")):
        df = df.withColumn(f"{side}_time", F.when(whole, F.coalesce(F.least(p, s), F.lit(horizon))).cast("int"))
    won = (c("long_outcome") == 1).cast("int") - (c("short_outcome") == 1).cast("int")
    return df.withColumn("tb_label", won).drop("_bid", "_ask", "_el", "_es", "_a", "_lp", "_ls", "_sp", "_ss")


def reward(df: DataFrame, horizon: int = 10, profit: float = 1.2, stop: float = 0.8, cost: float = 0.02, atr: str = "atr_6") -> DataFrame:
    """A long trade's result at the first barrier or the horizon's end, less cost, and what it went through (L2, L4)."""
    ahead = following(1, horizon)
    df = df.withColumns({"_p": F.collect_list("close").over(ahead), "_a": c(atr)})
    hit = first_hit("_p", lambda p: (p >= c("close") + profit * c("_a")) | (p <= c("close") - stop * c("_a")))
    df = df.withColumn("_h", hit)
    whole = (F.size("_p") == horizon) & c("_a").isNotNull()
    left = F.when(whole, F.get("_p", F.coalesce(c("_h").cast("int"), F.lit(horizon - 1))))
    seen = F.slice("_p", F.lit(1), F.coalesce(c("_h").cast("int") + 1, F.lit(horizon)))
    move = left - c("close")
    df = df.withColumns(
        {
            "reward": move - cost,
            "exit": F.when(~whole, None).when(c("_h").isNull(), "timeout").when(move > 0, "profit").otherwise("stop"),
            "mae": F.when(whole, F.greatest(c("close") - F.array_min(seen), F.lit(0.0))),
            "mfe": F.when(whole, F.greatest(F.array_max(seen) - c("close"), F.lit(0.0))),
        }
    )
    df = df.withColumn("path_quality", F.when(whole, c("mfe") / (c("mfe") + c("mae") + 1e-9)))
    return df.drop("_p", "_a", "_h")


def conditional_horizon(df: DataFrame, params: DataFrame, on: list[str], longest: int, atr: str = "atr_6") -> DataFrame:
    """Barriers and horizons by a parameter table (profit, stop, horizon) on columns such as session (L3); it is small by nature."""
    ahead = following(1, longest)
    df = df.join(params, on, "left").withColumn("_p", F.slice(F.collect_list("close").over(ahead), F.lit(1), c("horizon")))
    up = first_hit("_p", lambda p: p >= c("close") + c("profit") * c(atr))
    down = first_hit("_p", lambda p: p <= c("close") - c("stop") * c(atr))
    df = df.withColumns({"_u": up, "_d": down})
    whole = (F.size("_p") == c("horizon")) & c(atr).isNotNull()
    label = F.when(~whole, None).when(c("_u").isNotNull() & (c("_d").isNull() | (c("_u") <= c("_d"))), 1).when(c("_d").isNotNull(), -1).otherwise(0)
    return df.withColumn("label", label).drop("_p", "_u", "_d")


def slippage_multiplier(df: DataFrame, n: int = 60, atr: str = "atr_6") -> DataFrame:
    """How much dearer trading is than at the median range and spread, from 1 to 3."""
    r = Roll(n, 10)
    up = lambda x: F.greatest(c(x) / (r.quantile(c(x), 0.5) + 1e-9), F.lit(1.0))
    return df.withColumn("slippage_mult", F.least((up(atr) + up("spread")) / 2, F.lit(3.0)))


def executable_utility(df: DataFrame, horizon: int = 10, profit: float = 1.2, stop: float = 0.8, atr: str = "atr_6") -> DataFrame:
    """A long trade on executable quotes, where a bar that meets both barriers stops first."""
    half = c("spread") / 2
    bar = F.struct((c("low") - half).alias("lo"), (c("high") - half).alias("hi"), (c("close") - half).alias("z"))
    df = df.withColumns({"_b": F.collect_list(bar).over(following(1, horizon)), "_e": c("close") + half})
    tp, sl = c("_e") + profit * c(atr), c("_e") - stop * c(atr)
    s = first_hit("_b", lambda b: b.lo <= sl)
    t = first_hit("_b", lambda b: b.hi >= tp)
    df = df.withColumns({"_s": s, "_t": t})
    whole = (F.size("_b") == horizon) & c(atr).isNotNull()
    pnl = F.when(~whole, None).when(c("_s").isNotNull() & (c("_t").isNull() | (c("_s") <= c("_t"))), sl - c("_e")).when(c("_t").isNotNull(), tp - c("_e")).otherwise(F.get("_b", F.lit(horizon - 1)).z - c("_e"))
    return df.withColumn("utility", pnl).drop("_b", "_e", "_s", "_t")


def path_quantiles(df: DataFrame, horizon: int = 10, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Nearest-rank quantiles of the moves over the next bars, and whether they agree on a side."""
    path = F.array_sort(F.transform(F.collect_list("close").over(following(1, horizon)), lambda p: p - c("close")))
    df = df.withColumn("_p", path)
    whole = F.size("_p") == horizon
    df = df.withColumns({f"q{int(100 * q)}": F.when(whole, F.element_at("_p", int((horizon - 1) * q + 0.5) + 1)) for q in at})
    lo, hi = f"q{int(100 * at[0])}", f"q{int(100 * at[-1])}"
    return df.withColumn("conviction", F.when(c(lo) > 0, 1).when(c(hi) < 0, -1).when(c(lo).isNotNull(), 0)).drop("_p")


def sequences(df: DataFrame, features: list[str], steps: int, every: int = 1, bad: str = "", bad_share: float = 0.05) -> DataFrame:
    """For each row the last steps rows' features, whole windows only, every so many of them (L10, L11), if few rows are bad."""
    last = Roll(steps).window
    df = df.withColumns({"_seq": F.collect_list(F.array(*map(c, features))).over(last), "_bad": F.sum(c(bad).cast("double") if bad else F.lit(0.0)).over(last)})
    keep = (F.size("_seq") == steps) & (c("_bad") <= bad_share * steps)
    thin = F.filter("_seq", lambda x, i: (steps - 1 - i) % every == 0)
    return df.filter(keep).withColumn("sequence", thin).drop("_seq", "_bad")
