"""Queries for the bar indicators, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import rounded
from tidemark.operators import bars as B
from tidemark.operators import indicators as I
from tidemark.plans.sql import clip, lag, nearest, over, query, ret, roll
from tidemark.sources.tables import ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = ["symbol", "ts", "open", "high", "low", "close", "volume", "spread", "bid_close", "ask_close", "n"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.time_bars(ticks(spark, sf_dir))


def add(name: str, f: Callable[[DataFrame], DataFrame], steps: list[dict[str, str]], numbers: list[str], plain: tuple[str, ...] = ()) -> None:
    """A query over the bars that returns symbol, ts and what f adds of the named columns."""
    QUERIES[name] = lambda spark, d: rounded(f(bars(spark, d)).select("symbol", "ts", *plain, *numbers))
    SQL[name] = query(steps, numbers, plain=plain)


R = {"r": ret()}
TR = "greatest(high - low, abs(high - {p}), abs(low - {p}))".format(p="pc")
TYP = "((high + low + close) / 3)"
V1 = "(CASE WHEN volume = 0 THEN 1.0 ELSE volume END)"
SIGN = "sign(close - open)"

add("W1_ofi", I.order_flow, [{"s": f"CASE WHEN volume <> 0 THEN {SIGN} END"}, {"ofi": roll("avg", "s", 20)}], ["ofi"])
add("W2_obi_proxy", I.close_location, [{"obi_proxy": clip("((close - low) / (high - low + 1e-9))", 0, 1)}], ["obi_proxy"])
add("W3_tar", I.arrival_rate, [{"tar": f"(volume - {roll('avg', 'volume', 30)}) / ({roll('stddev_samp', 'volume', 30)} + 1e-9)"}], ["tar"])
add(
    "W4_kyle_lambda", I.kyle_lambda,
    [R | {"q": f"volume * {SIGN}"}, {"z": f"(q - {roll('avg', 'q', 20)}) / ({roll('stddev_samp', 'q', 20)} + 1e-9)"},
     {"kyles_lambda": f"1e4 * ({roll('avg', '(r * z)', 20)} - {roll('avg', 'r', 20)} * {roll('avg', 'z', 20)})"}],
    ["kyles_lambda"],
)
add("W5_amihud", I.amihud, [R | {"v": f"volume / ({roll('avg', 'volume', 20)} + 1e-9)"}, {"x": "abs(r) / (v + 1e-9)"}, {"amihud_illiq": f"1e4 * {roll('avg', 'x', 20)}"}], ["amihud_illiq"])
add(
    "W8_vpin", lambda df: I.vpin(df, 20, 20),
    [{"b": roll("sum", "(CASE WHEN close > open THEN volume ELSE 0.0 END)", 20), "s": roll("sum", "(CASE WHEN close < open THEN volume ELSE 0.0 END)", 20)},
     {"t": "abs(b - s) / (b + s + 1e-9)"}, {"vpin": roll("avg", "t", 20)}],
    ["vpin"],
)
add(
    "W9_realized_spread", I.realized_spread,
    [{"h": "ln(high / low)"}, {"e": f"exp(sqrt(h * {lag('h')}))"}, {"s": "2 * (e - 1) / (1 + e)"}, {"realized_spread": roll("avg", "s", 10)}], ["realized_spread"],
)
add(
    "W10_vol_regime", lambda df: I.volatility_terciles(df, 20),
    [R, {"v": roll("stddev_samp", "r", 20)}, {"lo": nearest("v", 0.33, 20), "hi": nearest("v", 0.66, 20)},
     {"regime_class": "CASE WHEN v IS NULL OR hi IS NULL THEN NULL WHEN v <= lo THEN 0 WHEN v <= hi THEN 1 ELSE 2 END"},
     {f"vol_regime_state_{s}_prob": roll("avg", f"CAST(regime_class = {s} AS INT)", 20) for s in range(3)} | {"regime_label": "CAST(regime_class - 1 AS DOUBLE)"}],
    ["vol_regime_state_0_prob", "vol_regime_state_1_prob", "vol_regime_state_2_prob", "regime_label"], ("regime_class",),
)
RUN = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
add(
    "W11_cusum", lambda df: I.cusum(df, 20),
    [R, {"z": f"abs((r - {roll('avg', 'r', 20)}) / ({roll('stddev_samp', 'r', 20)} + 1e-9))"}, {"c": f"CASE WHEN z IS NOT NULL THEN sum(z) {RUN} END"}, {"cpd_cusum": roll("avg", "c", 20)}],
    ["cpd_cusum"],
)
add(
    "W12_regime_runs", I.regime_runs,
    [{"g": f"CASE WHEN coalesce({ret()}, 0) > 0 THEN 1 ELSE -1 END"}, {"x": f"coalesce(CAST(g <> {lag('g')} AS INT), 0)"}, {"regime_change_count": f"CAST(sum(x) {RUN} AS BIGINT)"},
     {"regime_run_length": "CAST(row_number() OVER (PARTITION BY symbol, regime_change_count ORDER BY ts) AS INT)"}],
    [], ("regime_change_count", "regime_run_length"),
)
add(
    "W13_breakers", I.drawdown_breakers,
    [{"r": f"close / {lag('close')} - 1"}, {"e": f"exp(sum(ln(1 + r)) {RUN})"}, {"p": f"max(e) {RUN}"}, {"drawdown": "e / p - 1"},
     {"drawdown_breach": "CAST(drawdown < -0.1 AS INT)", "daily_loss_breach": f"CAST({roll('sum', 'r', 20)} < -0.03 AS INT)",
      "var_95_breach": f"CAST(r < {nearest('r', 0.05, 60)} AS INT)", "var_99_breach": f"CAST(r < {nearest('r', 0.01, 60)} AS INT)"}],
    ["drawdown"], ("drawdown_breach", "daily_loss_breach", "var_95_breach", "var_99_breach"),
)
PC = {"pc": lag("close")}
ATR = [PC, {"tr": f"CASE WHEN pc IS NULL THEN high - low ELSE {TR} END"}]
RATIOS = lambda x: {f"{x}_ratio_{a}_{b}": clip(f"({x}_{a} / ({x}_{b} + 1e-9))", 0.1, 10.0) for a, b in ((6, 20), (20, 60))}
add("W15_atr", I.atr, [*ATR, {f"atr_{n}": roll("avg", "tr", n) for n in (6, 20, 60)}, RATIOS("atr")], ["atr_6", "atr_20", "atr_60", "atr_ratio_6_20", "atr_ratio_20_60"])
add("W16_volatility", I.volatility, [R, {f"vol_{n}": roll("stddev_samp", "r", n) for n in (6, 20, 60)}, RATIOS("vol")], ["vol_6", "vol_20", "vol_60", "vol_ratio_6_20", "vol_ratio_20_60"])
add(
    "W17_bollinger", I.bollinger,
    [{"bb_mid": roll("avg", "close", 20), "s": roll("stddev_samp", "close", 20)}, {"bb_upper": "bb_mid + 2 * s", "bb_lower": "bb_mid - 2 * s"},
     {"bb_width": "(bb_upper - bb_lower) / (bb_mid + 1e-9)", "bb_pct": clip("((close - bb_lower) / (bb_upper - bb_lower + 1e-9))", 0, 1)}],
    ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct"],
)
add(
    "W18_rsi", I.rsi,
    [{"d": f"close - {lag('close')}"}, {"g": "CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END", "l": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END"},
     {"rsi_14": f"100 - 100 / (1 + {roll('avg', 'g', 14)} / ({roll('avg', 'l', 14)} + 1e-9))"}],
    ["rsi_14"],
)


def s_ema(x: str, span: int) -> str:
    a, w = 2 / (span + 1), f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {I.ema_weights(span)} PRECEDING AND CURRENT ROW)"
    return f"list_reduce(list({x}) {w}, lambda s, v: s * {1 - a!r} + v * {a!r})"


add("W19_macd", I.macd, [{"f": s_ema("close", 12), "s": s_ema("close", 26)}, {"macd": "f - s"}, {"macd_sig": s_ema("macd", 9)}, {"macd_hist": "macd - macd_sig"}], ["macd", "macd_sig", "macd_hist"])
add("W20_lag_returns", I.lag_returns, [{f"ret_{n}": ret(n=n) for n in (5, 20, 60)}], ["ret_5", "ret_20", "ret_60"])
add("W21_stochastic", I.stochastic, [{"l": roll("min", "low", 14), "h": roll("max", "high", 14)}, {"stoch_k": "100 * (close - l) / (h - l + 1e-9)"}, {"stoch_d": roll("avg", "stoch_k", 3)}], ["stoch_k", "stoch_d"])
add("W22_williams", I.williams, [{"l": roll("min", "low", 14), "h": roll("max", "high", 14)}, {"williams_r": "-100 * (h - close) / (h - l + 1e-9)"}], ["williams_r"])
add("W23_cci", I.cci, [{"t": TYP}, {"m": roll("avg", "t", 20)}, {"d": roll("avg", "abs(t - m)", 20)}, {"cci": "(t - m) / (0.015 * (d + 1e-9))"}], ["cci"])
CANDLE = {"candle_body": "abs(close - open)", "candle_range": "high - low", "upper_shadow": "high - greatest(open, close)", "lower_shadow": "least(open, close) - low"}
add("W24_candles", I.candles, [CANDLE], list(CANDLE))
add(
    "W25_single_patterns", I.single_patterns,
    [CANDLE, {"s": "candle_range + 1e-9"},
     {"is_doji": "CAST(candle_body / s <= 0.1 AS INT)", "is_hammer": "CAST(candle_body / s <= 0.3 AND lower_shadow / s >= 0.6 AND upper_shadow / s <= 0.1 AS INT)",
      "is_shooting_star": "CAST(candle_body / s <= 0.3 AND upper_shadow / s >= 0.6 AND lower_shadow / s <= 0.1 AS INT)"}],
    [], ("is_doji", "is_hammer", "is_shooting_star"),
)
EARLIER = {f"{x[0]}{k}": lag(x, k) for x in ("open", "close") for k in (1, 2)}
add(
    "W26_engulfing_harami", I.two_bar_patterns,
    [EARLIER,
     {"engulfing": "CAST(close > open AND c1 < o1 AND open <= c1 AND close >= o1 AS INT) - CAST(close < open AND c1 > o1 AND open >= c1 AND close <= o1 AS INT)",
      "harami": "CAST(close > open AND c1 < o1 AND open > c1 AND close < o1 AS INT) - CAST(close < open AND c1 > o1 AND open < c1 AND close > o1 AS INT)"}],
    [], ("engulfing", "harami"),
)
add(
    "W27_stars", I.star_patterns,
    [EARLIER,
     {"morning_star": "CAST(c2 < o2 AND abs(c1 - o1) < 0.3 * abs(c2 - o2) AND least(o1, c1) < c2 AND close > open AND least(open, close) > c1 AND close > (o2 + c2) / 2 AS INT)",
      "evening_star": "CAST(c2 > o2 AND abs(c1 - o1) < 0.3 * abs(c2 - o2) AND greatest(o1, c1) > c2 AND close < open AND greatest(open, close) < c1 AND close < (o2 + c2) / 2 AS INT)"}],
    [], ("morning_star", "evening_star"),
)
add(
    "W28_soldiers_crows", I.three_bar_patterns,
    [EARLIER,
     {"three_white_soldiers": "CAST(close > open AND c1 > o1 AND c2 > o2 AND close > c1 AND c1 > c2 AS INT)", "three_black_crows": "CAST(close < open AND c1 < o1 AND c2 < o2 AND close < c1 AND c1 < c2 AS INT)"}],
    [], ("three_white_soldiers", "three_black_crows"),
)
add(
    "W29_vwap_bands", I.vwap_bands,
    [{"t": TYP, "v": V1}, {"vwap": f"{roll('sum', '(t * v)', 60)} / {roll('sum', 'v', 60)}"}, {"q": "(t - vwap) ** 2 * v"}, {"s": f"sqrt({roll('sum', 'q', 60)} / ({roll('sum', 'v', 60)} + 1e-9))"},
     {"vwap_upper": "vwap + 2 * s", "vwap_lower": "vwap - 2 * s", "vwap_zscore": "(close - vwap) / (s + 1e-9)"}],
    ["vwap", "vwap_upper", "vwap_lower", "vwap_zscore"],
)
add("W30_volume_momentum", I.volume_momentum, [R, {"vwma_ret": f"{roll('sum', '(r * volume)', 20)} / nullif({roll('sum', 'volume', 20)}, 0)"}], ["vwma_ret"])
W_ = [f"w{k}" for k in range(10)]
VP = ["vp_poc_pos", "vp_poc_dist", "vp_poc_share", "vp_vw_pos", "vp_skew", "vp_va_width", "vp_in_va"]
add(
    "W31_volume_profile", I.volume_profile,
    [{"l": roll("min", "low", 60), "h": roll("max", "high", 60)}, {"b": clip("floor((close - l) / (h - l + 1e-9) * 10)", 0, 9)},
     {f"w{k}": roll("sum", f"(CASE WHEN b = {k} THEN volume ELSE 0.0 END)", 60) for k in range(10)} | {"t": roll("sum", "volume", 60)},
     {"ws": f"[{', '.join(W_)}]", "m": f"({' + '.join(f'{k} * w{k}' for k in range(10))}) / (t + 1e-9)"},
     {"p": "CASE WHEN t IS NOT NULL THEN list_position(ws, list_max(ws)) - 1.0 END", "d": f"sqrt(({' + '.join(f'w{k} * ({k} - m) ** 2' for k in range(10))}) / (t + 1e-9))"},
     {k: f"coalesce({v}, 0.0)" for k, v in zip(VP, ("p / 9", "(b - p) / 10", "list_max(ws) / (t + 1e-9)", "m / 9", "(m - p) / 9", "d / 10 * 10", "CAST(abs(b - p) <= d AS DOUBLE)"))}],
    VP,
)
E7 = range(1, 8)
CLOCK = [f"vol_clock_{x}" for x in ("pos", "ratio", "z", "pace", "hot")]
add(
    "W32_vol_clock", I.volatility_clock,
    [{"a": f"abs({ret()})", "day": "CAST(ts AS DATE)"}, {f"e{k}": f"coalesce({lag('a', 4 * k)}, 0.0)" for k in E7},
     {"m": f"({' + '.join(f'e{k}' for k in E7)}) / 7", "cum": "CASE WHEN a IS NOT NULL THEN sum(a) OVER (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING) END", "typ": f"{roll('avg', 'a', 28)} * 4"},
     {"sd": f"sqrt(greatest(({' + '.join(f'e{k} * e{k}' for k in E7)}) / 7 - m * m, 0.0))", "pace": "cum / (typ + 1e-9)", "pos": "(hour(ts) * 60 + minute(ts)) / 1440.0"},
     {k: f"coalesce({v}, 0.0)" for k, v in zip(CLOCK, ("pos", clip("(a / (m + 1e-9))", 0, 10), clip("((a - m) / (sd + 1e-9))", -10, 10), clip("pace", 0, 10), clip("(pace - pos)", -5, 10)))}],
    CLOCK,
)
OFI = [{"s": f"CASE WHEN volume <> 0 THEN {SIGN} END"}, {"ofi": roll("avg", "s", 20)}]
add("W35_ofi_surprise", I.flow_surprise, [*OFI, {"ofi_z": f"(ofi - {roll('avg', 'ofi', 60)}) / ({roll('stddev_samp', 'ofi', 60)} + 1e-9)"}], ["ofi", "ofi_z"])
add(
    "W36_breakout", I.breakout,
    [*ATR, {"atr_20": roll("avg", "tr", 20), "t": TYP, "v": V1}, {"breakout_pressure": f"(close - {roll('sum', '(t * v)', 60)} / {roll('sum', 'v', 60)}) / (atr_20 + 1e-9)"}],
    ["atr_20", "breakout_pressure"],
)
add("W37_liquidity_vacuum", I.liquidity_vacuum, [{"s": "coalesce(abs(ask_close - bid_close), 0.0001)"}, {"liquidity_vacuum": f"s / ({roll('q0.5', 's', 60)} + 1e-9)"}], ["liquidity_vacuum"])
add(
    "W38_fragility", I.fragility,
    [R, {"vol_20": roll("stddev_samp", "r", 20)}, *OFI, {"a": f"abs(sign(close - {lag('close', 10)}) - sign(ofi))"}, {"vol_of_vol": roll("stddev_samp", "vol_20", 20), "price_ofi_div": roll("avg", "a", 10)}],
    ["vol_of_vol", "price_ofi_div"],
)
add(
    "W39_spread_cost", I.spread_cost,
    [*ATR, {"atr_6": roll("avg", "tr", 6), "sp": "spread / 0.01"}, {"z": clip(f"((sp - {roll('avg', 'sp', 240, 20)}) / (nullif({roll('stddev_samp', 'sp', 240, 20)}, 0) + 1e-9))", -8, 8)},
     {"spread_zscore": "coalesce(z, 0.0)", "spread_percentile": "1 / (1 + exp(-1.702 * coalesce(z, 0.0)))", "spread_widening_5": f"coalesce(sp / ({roll('avg', 'sp', 5, 2)} + 1e-9), 1.0)",
      "spread_widening_20": f"coalesce(sp / ({roll('avg', 'sp', 20, 5)} + 1e-9), 1.0)", "cost_to_atr": "coalesce(sp / (atr_6 / 0.01 + 1e-9), 0.0)"}],
    ["spread_zscore", "spread_percentile", "spread_widening_5", "spread_widening_20", "cost_to_atr"],
)
add(
    "W40_market_regime", I.directional_regime,
    [*ATR, {"u": f"high - {lag('high')}", "d": f"{lag('low')} - low", "mv": "abs(close - pc)"},
     {"pu": "CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END", "pd": "CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END", "st": roll("sum", "tr", 14, 5)},
     {"pi": f"100 * {roll('sum', 'pu', 14, 5)} / (st + 1e-9)", "mi": f"100 * {roll('sum', 'pd', 14, 5)} / (st + 1e-9)"}, {"dx": "100 * abs(pi - mi) / (pi + mi + 1e-9)"},
     {"adx_14": roll("avg", "dx", 14, 5), "chop_14": f"100 * log10(st / ({roll('max', 'high', 14, 5)} - {roll('min', 'low', 14, 5)} + 1e-9) + 1e-9) / {math.log10(14)!r}",
      "efficiency_14": f"abs(close - {lag('close', 14)}) / ({roll('sum', 'mv', 14)} + 1e-9)"}],
    ["adx_14", "chop_14", "efficiency_14"],
)
add("W43_vol_filter", I.volatility_filter, [*ATR, {"atr_6": roll("avg", "tr", 6)}, {"vol_ok": f"CAST(atr_6 <= 3 * {roll('avg', 'atr_6', 60)} AS DOUBLE)"}], ["vol_ok"])
add(
    "W56_realized_moments", I.realized_moments,
    [R, {f"m{k}": roll("avg", f"pow(r, {k})", 20) for k in range(1, 5)}, {"v": "m2 - m1 * m1", "up": roll("stddev_samp", "(CASE WHEN r > 0 THEN r END)", 20, 2), "dn": roll("stddev_samp", "(CASE WHEN r < 0 THEN r END)", 20, 2)},
     {"realized_skew": "CASE WHEN v > 1e-12 THEN (m3 - 3 * m1 * m2 + 2 * m1 ** 3) / pow(v, 1.5) END", "realized_kurt": "CASE WHEN v > 1e-12 THEN (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 ** 4) / (v * v) - 3 END",
      "up_down_vol": "CASE WHEN m1 IS NOT NULL THEN up / (dn + 1e-9) END"}],
    ["realized_skew", "realized_kurt", "up_down_vol"],
)
add(
    "W58_tick_rule", I.tick_rule,
    [{"d": f"close - {lag('close')}"}, {"s": "sign(d) * volume"}, {"tick_imbalance": roll("sum", "s", 20), "v": roll("sum", "volume", 20), "a": roll("sum", "abs(d)", 20)},
     {"tick_imbalance_ratio": "tick_imbalance / (v + 1e-9)", "tick_impact": "a / (v + 1e-9)"}],
    ["tick_imbalance", "tick_imbalance_ratio", "tick_impact"],
)
add(
    "W59_clock", I.clock,
    [{"dd": f"{2 * math.pi!r} * (hour(ts) * 60 + minute(ts)) / 1440.0", "ww": f"{2 * math.pi!r} * (isodow(ts) - 1) / 7.0"},
     {"tod_sin": "sin(dd)", "tod_cos": "cos(dd)", "dow_sin": "sin(ww)", "dow_cos": "cos(ww)", "is_asia": "CAST(hour(ts) < 8 AS INT)", "is_london": "CAST(hour(ts) BETWEEN 7 AND 15 AS INT)", "is_ny": "CAST(hour(ts) BETWEEN 12 AND 20 AS INT)"}],
    ["tod_sin", "tod_cos", "dow_sin", "dow_cos"], ("is_asia", "is_london", "is_ny"),
)
add(
    "W61_range_volatility", I.range_volatility,
    [R | {"p": "ln(high / low) ** 2", "g": f"0.5 * ln(high / low) ** 2 - {2 * math.log(2) - 1!r} * ln(close / open) ** 2"}, {"parkinson_vol": f"sqrt({roll('avg', 'p', 20)} / {4 * math.log(2)!r})"},
     {"parkinson_ratio": f"parkinson_vol / ({roll('stddev_samp', 'r', 20)} + 1e-9)", "garman_klass_vol": f"sqrt(greatest({roll('avg', 'g', 20)}, 0.0))"}],
    ["parkinson_vol", "parkinson_ratio", "garman_klass_vol"],
)


def weights(d: float = 0.4, threshold: float = 1e-2) -> list[float]:
    out = [1.0]
    while abs(w := -out[-1] * (d - len(out) + 1) / len(out)) >= threshold:
        out.append(w)
    return out


add(
    "W68_fracdiff", I.fractional_difference,
    [{"x": "ln(close)"}, {"fracdiff": f"CASE WHEN count(x) {over(len(weights()))} >= {len(weights())} THEN " + " + ".join(f"{w!r} * {'x' if k == 0 else lag('x', k)}" for k, w in enumerate(weights())) + " END"}],
    ["fracdiff"],
)


def halo_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average true range by (symbol, bucket) windows with halo rows, for symbols too long for one task."""
    split = B.in_buckets(bars(spark, sf_dir), back=21, size=50)
    w = Window.partitionBy("symbol", "bucket").orderBy("ts")
    before = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    last = w.rowsBetween(-19, 0)
    out = split.withColumn("tr", tr).withColumn("atr_20", F.when(F.count("tr").over(last) >= 20, F.avg("tr").over(last)))
    return rounded(out.filter(~F.col("halo")).select("symbol", "ts", "atr_20"))


QUERIES["halo_atr"] = halo_atr
SQL["halo_atr"] = query([*ATR, {"atr_20": roll("avg", "tr", 20)}], ["atr_20"])
