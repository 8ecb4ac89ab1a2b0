"""The catalogue of bar features: what each is called, which group it is of, which operator makes it and what it needs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.sources.store import with_parts

BARS = ("open", "high", "low", "close", "volume", "spread")


@dataclass(frozen=True)
class Feature:
    """One feature; needs names bar columns or other features."""

    name: str
    group: str
    source: str
    needs: tuple[str, ...]
    type: str = "double"


def _of(group: str, make: Callable[[DataFrame], DataFrame], needs: str, outputs: str) -> tuple[str, Callable, list[Feature]]:
    return make.__name__, make, [Feature(n, group, make.__name__, tuple(needs.split())) for n in outputs.split()]


_TABLE = [
    _of("flow", I.order_flow, "open close volume", "ofi"),
    _of("flow", I.flow_surprise, "ofi", "ofi_z"),
    _of("flow", I.close_location, "high low close", "obi_proxy"),
    _of("flow", I.arrival_rate, "volume", "tar"),
    _of("flow", I.tick_rule, "close volume", "tick_imbalance tick_imbalance_ratio tick_impact"),
    _of("flow", I.vpin, "close open volume", "vpin"),
    _of("liquidity", I.kyle_lambda, "close volume", "kyles_lambda"),
    _of("liquidity", I.amihud, "close volume", "amihud_illiq"),
    _of("liquidity", I.realized_spread, "high low", "realized_spread"),
    _of("liquidity", I.liquidity_vacuum, "spread", "liquidity_vacuum"),
    _of("cost", I.spread_cost, "spread high low close", "spread_zscore spread_percentile spread_widening_5 spread_widening_20 cost_to_atr"),
    _of("volatility", I.atr, "high low close", "atr_6 atr_20 atr_60 atr_ratio_6_20 atr_ratio_20_60"),
    _of("volatility", I.volatility, "close", "vol_6 vol_20 vol_60 vol_ratio_6_20 vol_ratio_20_60"),
    _of("volatility", I.range_volatility, "open high low close", "parkinson_vol parkinson_ratio garman_klass_vol"),
    _of("volatility", I.realized_moments, "close", "realized_skew realized_kurt up_down_vol"),
    _of("volatility", I.fragility, "close volume open", "vol_of_vol price_ofi_div"),
    _of("volatility", I.volatility_clock, "close", "vol_clock_pos vol_clock_ratio vol_clock_z vol_clock_pace vol_clock_hot"),
    _of("volatility", I.volatility_filter, "high low close", "vol_ok"),
    _of("regime", I.volatility_terciles, "close", "regime_class vol_regime_state_0_prob vol_regime_state_1_prob vol_regime_state_2_prob regime_label"),
    _of("regime", I.cusum, "close", "cpd_cusum"),
    _of("regime", I.directional_regime, "high low close", "adx_14 chop_14 efficiency_14"),
    _of("regime", I.regime_runs, "regime_class", "regime_change_count regime_run_length"),
    _of("risk", I.drawdown_breakers, "close", "drawdown drawdown_breach daily_loss_breach var_95_breach var_99_breach"),
    _of("momentum", I.rsi, "close", "rsi_14"),
    _of("momentum", I.macd, "close", "macd macd_sig macd_hist"),
    _of("momentum", I.lag_returns, "close", "ret_5 ret_20 ret_60"),
    _of("momentum", I.stochastic, "high low close", "stoch_k stoch_d"),
    _of("momentum", I.williams, "high low close", "williams_r"),
    _of("momentum", I.cci, "high low close", "cci"),
    _of("momentum", I.volume_momentum, "close volume", "vwma_ret"),
    _of("momentum", I.fractional_difference, "close", "fracdiff"),
    _of("bands", I.bollinger, "close", "bb_mid bb_upper bb_lower bb_width bb_pct"),
    _of("bands", I.vwap_bands, "high low close volume", "vwap vwap_upper vwap_lower vwap_zscore"),
    _of("bands", I.breakout, "vwap atr_20", "breakout_pressure"),
    _of("candles", I.single_patterns, "open high low close", "candle_body candle_range upper_shadow lower_shadow is_doji is_hammer is_shooting_star"),
    _of("candles", I.two_bar_patterns, "open close", "engulfing harami"),
    _of("candles", I.star_patterns, "open high low close", "morning_star evening_star"),
    _of("candles", I.three_bar_patterns, "open close", "three_white_soldiers three_black_crows"),
    _of("profile", I.volume_profile, "high low close volume", "vp_poc_pos vp_poc_dist vp_poc_share vp_vw_pos vp_skew vp_va_width vp_in_va"),
    _of("clock", I.clock, "", "tod_sin tod_cos dow_sin dow_cos is_asia is_london is_ny"),
]
MAKERS = {name: make for name, make, _ in _TABLE}
FEATURES = {f.name: f for _, _, features in _TABLE for f in features}


def chosen(groups: Iterable[str] | None = None, names: Iterable[str] = (), mask: dict[str, bool] | None = None, without: Iterable[str] = ()) -> list[str]:
    """Feature names, in the catalogue's order: of the groups and by name, less those that the mask turns off and the groups without."""
    groups, names, mask = (set(groups) if groups is not None else None), set(names), mask or {}
    if unknown := (names | mask.keys()) - FEATURES.keys():
        raise KeyError(f"not in the catalogue: {sorted(unknown)}")
    inside = lambda f: (groups is None and not names) or f.name in names or (groups is not None and f.group in groups)
    return [f.name for f in FEATURES.values() if inside(f) and mask.get(f.name, True) and f.group not in set(without)]


def ablations(names: list[str]) -> dict[str, list[str]]:
    """For each group among the names, the names without it."""
    return {g: [n for n in names if FEATURES[n].group != g] for g in dict.fromkeys(FEATURES[n].group for n in names)}


def ordered(names: Iterable[str]) -> list[str]:
    """The operators that make the names, each after what it needs; the features form no cycle."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in FEATURES and FEATURES[name].source not in out:
            for n in FEATURES[name].needs:
                visit(n)
            out.append(FEATURES[name].source)

    for n in names:
        visit(n)
    return out


def materialise(bars: DataFrame, names: list[str], keep: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """keep and the named features of bars (G15); what they need on the way is made too and left out."""
    df = bars
    for source in ordered(names):
        df = MAKERS[source](df)
    return df.select(*keep, *names)


def as_table(spark: SparkSession) -> DataFrame:
    """The catalogue as rows: name, group, type, source, needs."""
    rows = [(f.name, f.group, f.type, f.source, list(f.needs)) for f in FEATURES.values()]
    return spark.createDataFrame(rows, "name string, group string, type string, source string, needs array<string>")


def stored_features(spark: SparkSession, path: str) -> DataFrame | None:
    """A feature store, or None where there is none yet."""
    try:
        found = spark.read.option("mergeSchema", True).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    return None if found.isEmpty() else found


def extend(bars: DataFrame, path: str, names: list[str], warm_up: str, overlap: str | None = None) -> None:
    """Brings a feature store up to date (G14): bars later than what the store has of their symbol are appended by month.

    Each symbol has a mark of its own, its latest time in the store, so one that lags behind is caught up; only its bars since that mark
    less the warm-up are read. A feature that the store doesn't have yet has no mark: it is made for all bars, and one
    that the store has is kept up though it isn't named. overlap: how far before its mark a symbol's rows are made
    anew, for bars that came late. Where stored rows change, the months they are in are written again with the rest of what they hold."""
    from tidemark.sources.store import kept

    spark = bars.sparkSession
    stored = stored_features(spark, path)
    if stored is None:
        new, rewrite = materialise(bars, names), False
    else:
        had = [n for n in stored.columns if n in FEATURES]
        every, fresh = list(dict.fromkeys([*had, *names])), [n for n in names if n not in had]
        mark = F.max("ts") - F.expr(f"INTERVAL {overlap}") if overlap else F.max("ts")
        marks = kept(stored.groupBy(F.col("symbol").alias("_of")).agg(mark.alias("_since")))
        told = lambda df: df.join(F.broadcast(marks), F.col("symbol").eqNullSafe(F.col("_of")), "left").drop("_of")  # noqa: E731  a row a symbol
        later = F.col("_since").isNull() | (F.col("ts") > F.col("_since"))
        read = told(bars).filter(F.col("_since").isNull() | (F.col("ts") >= F.col("_since") - F.expr(f"INTERVAL {warm_up}")))
        new = materialise(read, every, ("symbol", "ts", "_since")).filter(later).drop("_since")
        rewrite = bool(fresh or overlap)
        if rewrite:
            old = told(stored).filter(~later).select("symbol", "ts", *had)
            if fresh:
                made = materialise(bars, fresh, ("symbol", "ts")).select(F.col("symbol").alias("_of"), F.col("ts").alias("_at"), *fresh)
                old = old.join(made, F.col("symbol").eqNullSafe(F.col("_of")) & (F.col("ts") == F.col("_at")), "left").drop("_of", "_at")
            else:
                month = F.date_trunc("month", "ts")
                touched = told(stored).filter(later).select("ts").unionByName(new.select("ts")).select(month.alias("_month")).distinct()
                old = old.join(F.broadcast(touched), month == F.col("_month"), "left_semi")  # a row a month
            new = kept(new.unionByName(old))  # the store is read and written
    laid = with_parts(new).drop("day")
    mode = "overwrite" if rewrite else "append"
    laid.repartition("year", "month").sortWithinPartitions("symbol", "ts").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
