"""Indicators on bars: each takes a frame with symbol, ts and prices and adds columns; windows of one symbol share a sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Roll, clip, lag, layers, ln, log_return, ratio, running, series

c = F.col
EPS = 1e-9


def typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def true_range() -> Column:
    before = lag("close")
    return F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))


def never_zero(x: str) -> Column:
    return F.when(c(x) == 0, 1.0).otherwise(c(x))


def order_flow(df: DataFrame, n: int = 20) -> DataFrame:
    """ofi: mean sign of the bars that traded."""
    sign = F.signum(c("close") - c("open"))
    return layers(df, {"_s": F.when(c("volume") != 0, sign)}, {"ofi": Roll(n).avg(c("_s"))}).drop("_s")


def close_location(df: DataFrame) -> DataFrame:
    return df.withColumn("obi_proxy", clip((c("close") - c("low")) / (c("high") - c("low") + EPS), 0, 1))


def arrival_rate(df: DataFrame, n: int = 30) -> DataFrame:
    r = Roll(n)
    return df.withColumn("tar", (c("volume") - r.avg(c("volume"))) / (r.std(c("volume")) + EPS))


def kyle_lambda(df: DataFrame, n: int = 20) -> DataFrame:
    """Covariance of returns with signed volume in standard units, in basis points."""
    r = Roll(n)
    return layers(
        df,
        {"_r": log_return(), "_q": c("volume") * F.signum(c("close") - c("open"))},
        {"_z": (c("_q") - r.avg(c("_q"))) / (r.std(c("_q")) + EPS)},
        {"kyles_lambda": 1e4 * (r.avg(c("_r") * c("_z")) - r.avg(c("_r")) * r.avg(c("_z")))},
    ).drop("_r", "_q", "_z")


def amihud(df: DataFrame, n: int = 20) -> DataFrame:
    r = Roll(n)
    return layers(
        df,
        {"_a": F.abs(log_return()), "_v": c("volume") / (r.avg(c("volume")) + EPS)},
        {"amihud_illiq": 1e4 * r.avg(c("_a") / (c("_v") + EPS))},
    ).drop("_a", "_v")


def level_imbalance(df: DataFrame, bids: list[str], asks: list[str]) -> DataFrame:
    """One imbalance for each depth level, and that of all levels."""
    ratio = lambda b, a: (b - a) / (b + a + EPS)
    own = {f"obi_l{i + 1}": ratio(c(b), c(a)) for i, (b, a) in enumerate(zip(bids, asks))}
    return df.withColumns(own | {"obi_aggregate": ratio(sum(map(c, bids)), sum(map(c, asks)))})


def vpin(df: DataFrame, bucket: int = 50, buckets: int = 50) -> DataFrame:
    r = Roll(bucket)
    buy, sell = (F.when(t, c("volume")).otherwise(0.0) for t in (c("close") > c("open"), c("close") < c("open")))
    return layers(
        df, {"_b": r.sum(buy), "_s": r.sum(sell)}, {"_t": F.abs(c("_b") - c("_s")) / (c("_b") + c("_s") + EPS)}, {"vpin": Roll(buckets).avg(c("_t"))}
    ).drop("_b", "_s", "_t")


def realized_spread(df: DataFrame, n: int = 10) -> DataFrame:
    e = F.exp(F.sqrt(c("_h") * c("_p")))
    return layers(df, {"_h": ln(ratio(c("high"), c("low")))}, {"_p": lag("_h")}, {"_s": 2 * (e - 1) / (1 + e)}, {"realized_spread": Roll(n).avg(c("_s"))}).drop("_h", "_p", "_s")


def volatility_terciles(df: DataFrame, n: int = 60) -> DataFrame:
    """State 0 to 2 by where volatility stands among the last n, the share of each state, and a label."""
    r = Roll(n)
    state = F.when(c("_v").isNull() | c("_hi").isNull(), None).when(c("_v") <= c("_lo"), 0).when(c("_v") <= c("_hi"), 1).otherwise(2)
    return layers(
        df,
        {"_r": log_return()},
        {"_v": r.std(c("_r"))},
        {"_lo": r.nearest(c("_v"), 0.33), "_hi": r.nearest(c("_v"), 0.66)},
        {"regime_class": state},
        {f"vol_regime_state_{s}_prob": r.avg((c("regime_class") == s).cast("double")) for s in range(3)}
        | {"regime_label": F.when(c("regime_class") == 0, -1.0).when(c("regime_class") == 2, 1.0).when(c("regime_class") == 1, 0.0)},
    ).drop("_r", "_v", "_lo", "_hi")


def cusum(df: DataFrame, n: int = 60) -> DataFrame:
    r = Roll(n)
    return layers(
        df,
        {"_r": log_return()},
        {"_z": F.abs((c("_r") - r.avg(c("_r"))) / (r.std(c("_r")) + EPS))},
        {"_c": F.when(c("_z").isNotNull(), F.sum("_z").over(running()))},
        {"cpd_cusum": r.avg(c("_c"))},
    ).drop("_r", "_z", "_c")


def regime_runs(df: DataFrame) -> DataFrame:
    """How often the return's sign changed so far, and for how many bars it has held."""
    step = F.when(F.coalesce(log_return(), F.lit(0.0)) > 0, 1).otherwise(-1)
    return layers(
        df,
        {"_g": step},
        {"_x": F.coalesce((c("_g") != lag("_g")).cast("int"), F.lit(0))},
        {"regime_change_count": F.sum("_x").over(running())},
        {"regime_run_length": F.row_number().over(series(("symbol", "regime_change_count")))},
    ).drop("_g", "_x")


def drawdown_breakers(df: DataFrame, limit: float = 0.10, day: int = 20, day_limit: float = 0.03, var: int = 60) -> DataFrame:
    """Drawdown of the compounded return, and flags for it, for a day's loss and for historical value at risk."""
    flag = lambda x: x.cast("int")
    r = Roll(var)
    return layers(
        df,
        {"_r": c("close") / lag("close") - 1},
        {"_e": F.exp(F.sum(F.log1p("_r")).over(running()))},
        {"_p": F.max("_e").over(running())},
        {"drawdown": c("_e") / c("_p") - 1},
        {
            "drawdown_breach": flag(c("drawdown") < -limit),
            "daily_loss_breach": flag(Roll(day).sum(c("_r")) < -day_limit),
            "var_95_breach": flag(c("_r") < r.nearest(c("_r"), 0.05)),
            "var_99_breach": flag(c("_r") < r.nearest(c("_r"), 0.01)),
        },
    ).drop("_r", "_e", "_p")


def atr(df: DataFrame, windows: tuple[int, ...] = (6, 20, 60)) -> DataFrame:
    """Average true range over each window, and the ratios of neighbouring windows."""
    df = layers(df, {"_tr": true_range()}, {f"atr_{n}": Roll(n).avg(c("_tr")) for n in windows}).drop("_tr")
    return df.withColumns(ratios("atr", windows)) if len(windows) > 1 else df


def volatility(df: DataFrame, windows: tuple[int, ...] = (6, 20, 60)) -> DataFrame:
    df = layers(df, {"_r": log_return()}, {f"vol_{n}": Roll(n).std(c("_r")) for n in windows}).drop("_r")
    return df.withColumns(ratios("vol", windows)) if len(windows) > 1 else df


def ratios(name: str, windows: tuple[int, ...]) -> dict[str, Column]:
    return {f"{name}_ratio_{a}_{b}": clip(c(f"{name}_{a}") / (c(f"{name}_{b}") + EPS), 0.1, 10) for a, b in zip(windows, windows[1:])}


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    r = Roll(n)
    return layers(
        df,
        {"bb_mid": r.avg(c("close")), "_s": r.std(c("close"))},
        {"bb_upper": c("bb_mid") + k * c("_s"), "bb_lower": c("bb_mid") - k * c("_s")},
        {"bb_width": (c("bb_upper") - c("bb_lower")) / (c("bb_mid") + EPS), "bb_pct": clip((c("close") - c("bb_lower")) / (c("bb_upper") - c("bb_lower") + EPS), 0, 1)},
    ).drop("_s")


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    r = Roll(n)
    gain, loss = (F.when(c("_d").isNotNull(), F.greatest(x, F.lit(0.0))) for x in (c("_d"), -c("_d")))
    return layers(df, {"_d": c("close") - lag("close")}, {f"rsi_{n}": 100 - 100 / (1 + r.avg(gain) / (r.avg(loss) + EPS))}).drop("_d")


def ema_weights(span: int, tolerance: float = 1e-12) -> int:
    """Rows after which an exponential mean's older weights add up to less than tolerance."""
    return math.ceil(math.log(tolerance) / math.log(1 - 2 / (span + 1)))


def ema(x: str, span: int) -> Column:
    """The recursive exponential mean that starts at the first value, over a frame beyond which weights don't matter."""
    a = 2 / (span + 1)
    frame = series().rowsBetween(-ema_weights(span), 0)
    values = F.collect_list(x).over(frame)
    return F.aggregate(F.slice(values, 2, ema_weights(span)), F.element_at(values, 1), lambda s, v: s * (1 - a) + v * a)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return layers(df, {"_f": ema("close", fast), "_s": ema("close", slow)}, {"macd": c("_f") - c("_s")}, {"macd_sig": ema("macd", signal)}, {"macd_hist": c("macd") - c("macd_sig")}).drop("_f", "_s")


def lag_returns(df: DataFrame, windows: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    return df.withColumns({f"ret_{n}": log_return(n=n) for n in windows})


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    r = Roll(k)
    return layers(df, {"_l": r.min(c("low")), "_h": r.max(c("high"))}, {"stoch_k": 100 * (c("close") - c("_l")) / (c("_h") - c("_l") + EPS)}, {"stoch_d": Roll(d).avg(c("stoch_k"))}).drop("_l", "_h")


def implied_volatility(df: DataFrame, n: int = 20, per_year: float = 252.0) -> DataFrame:
    """iv_proxy: the yearly Garman-Klass volatility over n bars, null where the mean is below zero."""
    own = 0.5 * F.pow(ln("high") - ln("low"), 2) - (2 * math.log(2) - 1) * F.pow(log_return(), 2)
    mean = Roll(n).avg(c("_gk"))
    return df.withColumn("_gk", own).withColumn("iv_proxy", F.when(mean >= 0, F.sqrt(mean) * math.sqrt(per_year))).drop("_gk")


def williams(df: DataFrame, n: int = 14) -> DataFrame:
    r = Roll(n)
    top = r.max(c("high"))
    return df.withColumn("williams_r", -100 * (top - c("close")) / (top - r.min(c("low")) + EPS))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    r = Roll(n)
    return layers(df, {"_t": typical()}, {"_m": r.avg(c("_t"))}, {"_d": r.avg(F.abs(c("_t") - c("_m")))}, {"cci": (c("_t") - c("_m")) / (0.015 * (c("_d") + EPS))}).drop("_t", "_m", "_d")


def candles(df: DataFrame) -> DataFrame:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return df.withColumns({"candle_body": F.abs(c("close") - c("open")), "candle_range": c("high") - c("low"), "upper_shadow": c("high") - top, "lower_shadow": bottom - c("low")})


def single_patterns(df: DataFrame) -> DataFrame:
    """Doji, hammer and shooting star, from the parts of the bar's range."""
    span = c("candle_range") + EPS
    body, up, down = c("candle_body") / span, c("upper_shadow") / span, c("lower_shadow") / span
    shapes = {"is_doji": body <= 0.1, "is_hammer": (body <= 0.3) & (down >= 0.6) & (up <= 0.1), "is_shooting_star": (body <= 0.3) & (up >= 0.6) & (down <= 0.1)}
    return candles(df).withColumns({k: v.cast("int") for k, v in shapes.items()})


def with_earlier(df: DataFrame, n: int) -> DataFrame:
    """Opens and closes of up to n bars before, as _o1, _c1, ..."""
    return df.withColumns({f"_{x[0]}{k}": lag(x, k) for x in ("open", "close") for k in range(1, n + 1)})


def two_bar_patterns(df: DataFrame) -> DataFrame:
    """Engulfing and harami: 1 where bullish, -1 where bearish."""
    up, was_down = c("close") > c("open"), c("_c1") < c("_o1")
    down, was_up = c("close") < c("open"), c("_c1") > c("_o1")
    o, z = c("open"), c("close")
    signs = {
        "engulfing": (up & was_down & (o <= c("_c1")) & (z >= c("_o1")), down & was_up & (o >= c("_c1")) & (z <= c("_o1"))),
        "harami": (up & was_down & (o > c("_c1")) & (z < c("_o1")), down & was_up & (o < c("_c1")) & (z > c("_o1"))),
    }
    return with_earlier(df, 1).withColumns({k: a.cast("int") - b.cast("int") for k, (a, b) in signs.items()}).drop("_o1", "_c1")


def star_patterns(df: DataFrame) -> DataFrame:
    o, z, o1, z1, o2, z2 = map(c, ("open", "close", "_o1", "_c1", "_o2", "_c2"))
    small = F.abs(z1 - o1) < 0.3 * F.abs(z2 - o2)
    middle = (o2 + z2) / 2
    morning = (z2 < o2) & small & (F.least(o1, z1) < z2) & (z > o) & (F.least(o, z) > z1) & (z > middle)
    evening = (z2 > o2) & small & (F.greatest(o1, z1) > z2) & (z < o) & (F.greatest(o, z) < z1) & (z < middle)
    return with_earlier(df, 2).withColumns({"morning_star": morning.cast("int"), "evening_star": evening.cast("int")}).drop("_o1", "_c1", "_o2", "_c2")


def three_bar_patterns(df: DataFrame) -> DataFrame:
    o, z, o1, z1, o2, z2 = map(c, ("open", "close", "_o1", "_c1", "_o2", "_c2"))
    rising = (z > o) & (z1 > o1) & (z2 > o2) & (z > z1) & (z1 > z2)
    falling = (z < o) & (z1 < o1) & (z2 < o2) & (z < z1) & (z1 < z2)
    return with_earlier(df, 2).withColumns({"three_white_soldiers": rising.cast("int"), "three_black_crows": falling.cast("int")}).drop("_o1", "_c1", "_o2", "_c2")


def vwap_bands(df: DataFrame, n: int = 60, k: float = 2.0) -> DataFrame:
    r = Roll(n)
    return layers(
        df,
        {"_t": typical(), "_v": never_zero("volume")},
        {"vwap": r.sum(c("_t") * c("_v")) / r.sum(c("_v"))},
        {"_q": F.pow(c("_t") - c("vwap"), 2) * c("_v")},
        {"_s": F.sqrt(r.sum(c("_q")) / (r.sum(c("_v")) + EPS))},
        {"vwap_upper": c("vwap") + k * c("_s"), "vwap_lower": c("vwap") - k * c("_s"), "vwap_zscore": (c("close") - c("vwap")) / (c("_s") + EPS)},
    ).drop("_t", "_v", "_q", "_s")


def volume_momentum(df: DataFrame, n: int = 20) -> DataFrame:
    r = Roll(n)
    return layers(df, {"_r": log_return()}, {"vwma_ret": F.try_divide(r.sum(c("_r") * c("volume")), r.sum(c("volume")))}).drop("_r")


def volume_profile(df: DataFrame, n: int = 60, bins: int = 10) -> DataFrame:
    """Where volume gathered between a window's least low and largest high; zero until the window is full."""
    r = Roll(n)
    sums = F.array(*[F.coalesce(c(f"_w{k}"), F.lit(0.0)) for k in range(bins)])
    total = c("_t") + EPS
    spread = sum((c(f"_w{k}") * F.pow(F.lit(float(k)) - c("_m"), 2) for k in range(bins)), F.lit(0.0))
    made = ["vp_poc_pos", "vp_poc_dist", "vp_poc_share", "vp_vw_pos", "vp_skew", "vp_va_width", "vp_in_va"]
    last = bins - 1
    df = layers(
        df,
        {"_l": r.min(c("low")), "_h": r.max(c("high"))},
        {"_b": clip(F.floor((c("close") - c("_l")) / (c("_h") - c("_l") + EPS) * bins).cast("double"), 0, last)},
        {f"_w{k}": r.sum(F.when(c("_b") == k, c("volume")).otherwise(0.0)) for k in range(bins)} | {"_t": r.sum(c("volume"))},
        {"_p": F.when(c("_t").isNotNull(), F.array_position(sums, F.array_max(sums)) - 1.0), "_m": sum((k * c(f"_w{k}") for k in range(bins)), F.lit(0.0)) / total},
        {"_d": F.sqrt(spread / total)},
        {
            "vp_poc_pos": c("_p") / last,
            "vp_poc_dist": (c("_b") - c("_p")) / bins,
            "vp_poc_share": F.when(c("_t").isNotNull(), F.array_max(sums)) / total,
            "vp_vw_pos": c("_m") / last,
            "vp_skew": (c("_m") - c("_p")) / last,
            "vp_va_width": c("_d") / bins * 10,
            "vp_in_va": (F.abs(c("_b") - c("_p")) <= c("_d")).cast("double"),
        },
    )
    return df.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in made}).drop("_l", "_h", "_b", "_t", "_p", "_m", "_d", *[f"_w{k}" for k in range(bins)])


def volatility_clock(df: DataFrame, day: int = 4, days: int = 7) -> DataFrame:
    """Each absolute return against those of the same time on earlier days, and the day's pace; day: bars in a day."""
    earlier = [c(f"_e{k}") for k in range(1, days + 1)]
    known = [F.coalesce(e, F.lit(0.0)) for e in earlier]
    minute = F.hour("ts") * 60 + F.minute("ts")
    by_day = running(("symbol", "_day"))
    df = layers(
        df,
        {"_a": F.abs(log_return()), "_day": F.to_date("ts")},
        {f"_e{k}": lag("_a", day * k) for k in range(1, days + 1)},
        {"_m": sum(known, F.lit(0.0)) / days, "_cum": F.when(c("_a").isNotNull(), F.sum("_a").over(by_day)), "_typ": Roll(day * days).avg(c("_a")) * day},
        {"_sd": F.sqrt(F.greatest(sum((k * k for k in known), F.lit(0.0)) / days - c("_m") * c("_m"), F.lit(0.0))), "_pace": c("_cum") / (c("_typ") + EPS), "vol_clock_pos": minute / 1440.0},
        {
            "vol_clock_ratio": clip(c("_a") / (c("_m") + EPS), 0, 10),
            "vol_clock_z": clip((c("_a") - c("_m")) / (c("_sd") + EPS), -10, 10),
            "vol_clock_pace": clip(c("_pace"), 0, 10),
            "vol_clock_hot": clip(c("_pace") - c("vol_clock_pos"), -5, 10),
        },
    )
    made = [f"vol_clock_{x}" for x in ("pos", "ratio", "z", "pace", "hot")]
    return df.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in made}).drop("_a", "_day", "_m", "_cum", "_typ", "_sd", "_pace", *[f"_e{k}" for k in range(1, days + 1)])


def flow_surprise(df: DataFrame, fast: int = 20, slow: int = 60) -> DataFrame:
    r = Roll(slow)
    return order_flow(df, fast).withColumn("ofi_z", (c("ofi") - r.avg(c("ofi"))) / (r.std(c("ofi")) + EPS))


def breakout(df: DataFrame, vwap: int = 60, n: int = 20) -> DataFrame:
    r = Roll(vwap)
    df = layers(atr(df, (n,)), {"_t": typical(), "_v": never_zero("volume")}, {"breakout_pressure": (c("close") - r.sum(c("_t") * c("_v")) / r.sum(c("_v"))) / (c(f"atr_{n}") + EPS)})
    return df.drop("_t", "_v")


def liquidity_vacuum(df: DataFrame, n: int = 60) -> DataFrame:
    spread = F.coalesce(F.abs(c("ask_close") - c("bid_close")), F.lit(0.0001))
    return layers(df, {"_s": spread}, {"liquidity_vacuum": c("_s") / (Roll(n).quantile(c("_s"), 0.5) + EPS)}).drop("_s")


def fragility(df: DataFrame, n: int = 20, steps: int = 10) -> DataFrame:
    """Volatility of volatility, and how far price direction and order flow part."""
    df = order_flow(volatility(df, (n,)), n)
    away = F.abs(F.signum(c("close") - lag("close", steps)) - F.signum("ofi"))
    return layers(df, {"_a": away}, {"vol_of_vol": Roll(n).std(c(f"vol_{n}")), "price_ofi_div": Roll(steps).avg(c("_a"))}).drop("_a")


def spread_cost(df: DataFrame, pip: float = 0.01) -> DataFrame:
    """What trading costs against its own past and against the bar's range; neutral where little is known."""
    s = c("_s")
    slow, five, twenty = Roll(240, 20), Roll(5, 2), Roll(20, 5)
    sd = slow.std(s)
    df = layers(atr(df, (6,)), {"_s": c("spread") / pip}, {"_z": clip((s - slow.avg(s)) / (F.nullif(sd, F.lit(0.0)) + EPS), -8, 8)})
    return df.withColumns(
        {
            "spread_zscore": F.coalesce("_z", F.lit(0.0)),
            "spread_percentile": 1 / (1 + F.exp(-1.702 * F.coalesce("_z", F.lit(0.0)))),
            "spread_widening_5": F.coalesce(s / (five.avg(s) + EPS), F.lit(1.0)),
            "spread_widening_20": F.coalesce(s / (twenty.avg(s) + EPS), F.lit(1.0)),
            "cost_to_atr": F.coalesce(s / (c("atr_6") / pip + EPS), F.lit(0.0)),
        }
    ).drop("_s", "_z")


def directional_regime(df: DataFrame, n: int = 14, least: int = 5) -> DataFrame:
    """Directional movement index, choppiness and the share of net in total movement."""
    r = Roll(n, least)
    up, down = c("high") - lag("high"), lag("low") - c("low")
    return layers(
        df,
        {"_tr": F.coalesce(true_range(), c("high") - c("low")), "_u": up, "_d": down, "_m": F.abs(c("close") - lag("close"))},
        {"_pu": F.when((c("_u") > c("_d")) & (c("_u") > 0), c("_u")).otherwise(0.0), "_pd": F.when((c("_d") > c("_u")) & (c("_d") > 0), c("_d")).otherwise(0.0), "_sum": r.sum(c("_tr"))},
        {"_pi": 100 * r.sum(c("_pu")) / (c("_sum") + EPS), "_mi": 100 * r.sum(c("_pd")) / (c("_sum") + EPS)},
        {"_dx": 100 * F.abs(c("_pi") - c("_mi")) / (c("_pi") + c("_mi") + EPS)},
        {
            "adx_14": r.avg(c("_dx")),
            "chop_14": 100 * F.log10(c("_sum") / (r.max(c("high")) - r.min(c("low")) + EPS) + EPS) / math.log10(n),
            "efficiency_14": F.abs(c("close") - lag("close", n)) / (Roll(n).sum(c("_m")) + EPS),
        },
    ).drop("_tr", "_u", "_d", "_m", "_pu", "_pd", "_sum", "_pi", "_mi", "_dx")


def volatility_filter(df: DataFrame, mult: float = 3.0, n: int = 60) -> DataFrame:
    df = atr(df, (6,))
    return df.withColumn("vol_ok", (c("atr_6") <= mult * Roll(n).avg(c("atr_6"))).cast("double"))


def realized_moments(df: DataFrame, n: int = 20) -> DataFrame:
    """Skew and kurtosis of returns by raw moments, and upside against downside volatility."""
    r = Roll(n)
    x = c("_r")
    m = [r.avg(F.pow(x, k)) for k in range(1, 5)]
    df = layers(df, {"_r": log_return()}, {f"_m{k}": m[k - 1] for k in range(1, 5)})
    m1, m2, m3, m4 = (c(f"_m{k}") for k in range(1, 5))
    var = m2 - m1 * m1
    up, down = Roll(n, 2).std(F.when(x > 0, x)), Roll(n, 2).std(F.when(x < 0, x))
    return df.withColumns(
        {
            "realized_skew": F.when(var > 1e-12, (m3 - 3 * m1 * m2 + 2 * F.pow(m1, 3)) / F.pow(var, 1.5)),
            "realized_kurt": F.when(var > 1e-12, (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, 4)) / (var * var) - 3),
            "up_down_vol": F.when(m1.isNotNull(), up / (down + EPS)),
        }
    ).drop("_r", "_m1", "_m2", "_m3", "_m4")


def tick_rule(df: DataFrame, n: int = 20) -> DataFrame:
    """Volume by the sign of the last price change: imbalance, ratio, and price impact per unit."""
    r = Roll(n)
    return layers(
        df,
        {"_d": c("close") - lag("close")},
        {"_s": F.signum("_d") * c("volume")},
        {"tick_imbalance": r.sum(c("_s")), "_v": r.sum(c("volume")), "_a": r.sum(F.abs(c("_d")))},
        {"tick_imbalance_ratio": c("tick_imbalance") / (c("_v") + EPS), "tick_impact": c("_a") / (c("_v") + EPS)},
    ).drop("_d", "_s", "_v", "_a")


def clock(df: DataFrame) -> DataFrame:
    """The time of day and week as points on circles, and flags for three sessions by UTC hour."""
    day, week = 2 * math.pi * (F.hour("ts") * 60 + F.minute("ts")) / 1440.0, 2 * math.pi * F.weekday("ts") / 7.0
    h = F.hour("ts")
    flags = {"is_asia": (h >= 0) & (h < 8), "is_london": (h >= 7) & (h < 16), "is_ny": (h >= 12) & (h < 21)}
    return df.withColumns({"tod_sin": F.sin(day), "tod_cos": F.cos(day), "dow_sin": F.sin(week), "dow_cos": F.cos(week)} | {k: v.cast("int") for k, v in flags.items()})


def range_volatility(df: DataFrame, n: int = 20) -> DataFrame:
    """Volatility from highs and lows (Parkinson) and from opens too (Garman and Klass), against that of closes."""
    r = Roll(n)
    hl, co = F.pow(ln(ratio(c("high"), c("low"))), 2), F.pow(ln(ratio(c("close"), c("open"))), 2)
    df = layers(df, {"_r": log_return(), "_p": hl, "_g": 0.5 * hl - (2 * math.log(2) - 1) * co})
    parkinson = F.sqrt(r.avg(c("_p")) / (4 * math.log(2)))
    return df.withColumns(
        {"parkinson_vol": parkinson, "parkinson_ratio": parkinson / (r.std(c("_r")) + EPS), "garman_klass_vol": F.sqrt(F.greatest(r.avg(c("_g")), F.lit(0.0)))}
    ).drop("_r", "_p", "_g")


def fractional_difference(df: DataFrame, d: float = 0.4, threshold: float = 1e-2) -> DataFrame:
    """The fractional difference of log prices over a fixed window: weights below threshold are left out."""
    weights = [1.0]
    while abs(w := -weights[-1] * (d - len(weights) + 1) / len(weights)) >= threshold:
        weights.append(w)
    n = len(weights)
    x = F.log("close")
    terms = [w * (x if k == 0 else lag(x, k)) for k, w in enumerate(weights)]
    return df.withColumn("fracdiff", F.when(F.count(x).over(Roll(n).window) >= n, sum(terms[1:], terms[0])))
