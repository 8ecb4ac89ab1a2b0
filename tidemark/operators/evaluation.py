"""Judging models and features: Sharpe statistics, promotion gates, fold isolation, bootstraps, look-ahead scans, clusters."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import correlation, normal_cdf
from tidemark.sources.store import kept

EULER = 0.5772156649


def c(name: str) -> Column:
    return F.col(name)


def expected_best(trials: int) -> float:
    """The largest of so many independent standard normal Sharpe ratios that is to be expected by chance; 0 for one."""
    if trials <= 1:
        return 0.0
    root = math.sqrt(2 * math.log(trials))
    return (1 - EULER) * root + EULER / root


def sharpe_tests(returns: DataFrame, key: list[str], trials: int = 1, per_year: float = 252.0, benchmark: float = 0.0) -> DataFrame:
    """key, n, sharpe (of a period), psr (chance that the true one is above the yearly benchmark) and dsr (above what the best of
    so many trials gives by chance, a yearly figure) (T19). returns has a column r; n < 3 gives one half."""
    n, m = F.count("r"), F.avg("r")
    s = returns.groupBy(*key).agg(n.alias("n"), (m / F.stddev_samp("r")).alias("sharpe"), F.skewness("r").alias("sk"), (F.kurtosis("r") + 3).alias("ku"))
    wide = F.sqrt(F.greatest((1 - c("sk") * c("sharpe") + (c("ku") - 1) / 4 * c("sharpe") * c("sharpe")) / (c("n") - 1), F.lit(1e-18)))
    chance = lambda yearly: F.when(c("n") < 3, 0.5).otherwise(normal_cdf((c("sharpe") - yearly / math.sqrt(per_year)) / wide))
    return s.select(*key, "n", "sharpe", chance(benchmark).alias("psr"), chance(max(benchmark, expected_best(trials))).alias("dsr"))


#: Promotion thresholds: metric, whether it is a floor or a ceiling, bound (fixed values).
PROMOTION = (
    ("sharpe", "floor", 1.5),
    ("profit_factor", "floor", 1.5),
    ("max_drawdown", "ceiling", 0.20),
    ("trades", "floor", 500.0),
    ("regime_concentration", "ceiling", 0.75),
    ("cost_share", "ceiling", 0.30),
    ("calmar", "floor", 1.0),
    ("psr", "floor", 0.95),
    ("dsr", "floor", 0.95),
    ("sharpe_per_turnover", "floor", 0.10),
    ("sharpe_per_drawdown", "floor", 8.0),
    ("sharpe_per_latency", "floor", 0.05),
)


def promotion(metrics: DataFrame, key: list[str], rules: tuple[tuple[str, str, float], ...] = PROMOTION) -> DataFrame:
    """key, metric, value, passed for each rule whose metric the table has (T23). A null value doesn't pass."""
    have = [r for r in rules if r[0] in metrics.columns]
    rows = [F.struct(F.lit(n).alias("metric"), c(n).cast("double").alias("value"), F.coalesce((c(n) >= b) if kind == "floor" else (c(n) <= b), F.lit(False)).alias("passed")) for n, kind, b in have]
    return metrics.select(*key, F.explode(F.array(*rows)).alias("r")).select(*key, "r.*")


def promotion_metrics(trades: DataFrame, key: list[str], order: list[str], trials: int = 1, per_year: float = 252.0, least_drawdown: float = 0.01, cell: Column | None = None) -> DataFrame:
    """key and the twelve metrics of PROMOTION out of trades with r (net return), regime, cost, latency_ms and day.

    calmar is Sharpe over drawdown (at least least_drawdown), turnover is trades a day that has any, cost_share the costs in the
    returns won, regime_concentration the largest share of a regime's net result in all regimes' absolute ones. The
    drawdown comes from a scan in cells, so no task holds all trades of a model."""
    from tidemark.operators.stats import drawdowns

    won, lost = F.sum(F.when(c("r") > 0, c("r"))), -F.sum(F.when(c("r") < 0, c("r")))
    plain = trades.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("trades"), (F.avg("r") / F.stddev_samp("r") * math.sqrt(per_year)).alias("sharpe"), F.try_divide(won, lost).alias("profit_factor"),
        F.try_divide(F.sum("cost"), won).alias("cost_share"), F.avg("latency_ms").alias("_latency"),
    )
    days = trades.groupBy(*key, "day").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("one").alias("_days"))
    regimes = trades.groupBy(*key, "regime").agg(F.abs(F.sum("r")).alias("_net")).groupBy(*key).agg(F.try_divide(F.max("_net"), F.sum("_net")).alias("regime_concentration"))
    deep = drawdowns(trades, "r", key, order, cell).groupBy(*key).agg((-F.min("drawdown")).alias("max_drawdown"))
    chances = sharpe_tests(trades, key, trials, per_year).select(*key, "psr", "dsr")
    out = plain
    for part in (days, regimes, deep, chances):  # a row a key
        out = out.join(part, key)
    ratios = {
        "calmar": c("sharpe") / F.greatest("max_drawdown", F.lit(least_drawdown)),
        "sharpe_per_turnover": F.try_divide(c("sharpe"), c("trades") / c("_days")),
        "sharpe_per_drawdown": F.when(c("max_drawdown") > 0, c("sharpe") / c("max_drawdown")).otherwise(c("sharpe") * 100),
        "sharpe_per_latency": F.try_divide(c("sharpe"), c("_latency")),
    }
    return out.withColumns(ratios).drop("_latency", "_days")


def fold_isolation(rows: DataFrame, role: str, ts: str, fold: list[str], embargo: int, share: float = 0.8) -> DataFrame:
    """fold, train_last, first, gap and need (seconds), overlap, tight, isolated: whether a fold's validation rows start after its
    training rows and far enough off, in embargo times the median step of the training times (T15).

    Steps are counted by length, so the median needs no sorted column in one task."""
    seconds = F.unix_micros(c(ts).cast("timestamp")) / 1e6
    at = rows.select(*fold, c(role).alias("_role"), seconds.alias("_t"))
    ends = at.groupBy(*fold).agg(F.max(F.when(c("_role") == "train", c("_t"))).alias("train_last"), F.min(F.when(c("_role") != "train", c("_t"))).alias("first"))
    train = at.filter("_role = 'train'").select(*fold, "_t").distinct()
    step = c("_t") - F.lag("_t").over(Window.partitionBy(*fold).orderBy("_t"))
    steps = train.withColumn("_step", step).filter("_step is not null").groupBy(*fold, "_step").count()
    ahead = Window.partitionBy(*fold).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"_upto": F.sum("count").over(ahead), "_all": F.sum("count").over(Window.partitionBy(*fold))})
    middle = steps.filter(2 * c("_upto") >= c("_all")).groupBy(*fold).agg(F.min("_step").alias("_median"))
    out = ends.join(middle, fold, "left").withColumns({"gap": c("first") - c("train_last"), "need": embargo * F.coalesce("_median", F.lit(0.0))})
    out = out.withColumns({"overlap": F.coalesce(c("gap") <= 0, F.lit(False)), "tight": F.coalesce((c("gap") > 0) & (c("gap") < share * c("need")), F.lit(False))})
    return out.select(*fold, "train_last", "first", "gap", "need", "overlap", "tight", (~c("overlap") & ~c("tight")).alias("isolated"))


def bands(means: DataFrame, key: list[str]) -> DataFrame:
    return means.groupBy(*key).agg(F.percentile("m", 0.05).alias("low"), F.percentile("m", 0.5).alias("mid"), F.percentile("m", 0.95).alias("high"))


def bootstrap(rows: DataFrame, key: str, i: str, value: str, kind: str, replicates: int = 200, block: int = 10, seed: int = 0) -> DataFrame:
    """key, low, mid, high: bands of the mean of value over resampled series (T22). rows has i, each row's number in its key from 0.

    Draws are hashes of (key, replicate, place), so they are the same wherever they are made; rows come by an equal join.
    kind: block (blocks of a fixed length from any start, round the end), stationary (each place starts a new block with a chance of one in
    block), trade (each place for itself)."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    places = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), c("n") - 1)))
    draw = lambda place, salt: F.pmod(F.xxhash64(key, "rep", place, F.lit(seed + salt)), c("n"))
    if kind == "trade":
        picked = places.withColumn("_i", draw(c("at"), 0))
    elif kind == "block":
        first = F.floor(c("at") / block)
        picked = places.withColumn("_i", (draw(first, 0) + c("at") % block) % c("n"))
    else:
        fresh = (F.pmod(F.xxhash64(key, "rep", "at", F.lit(seed + 1)), F.lit(block)) == 0) | (c("at") == 0)
        run = Window.partitionBy(key, "rep").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        begun = places.withColumn("_b", F.last(F.when(fresh, c("at")), ignorenulls=True).over(run))
        picked = begun.withColumn("_i", (draw(c("_b"), 0) + c("at") - c("_b")) % c("n"))
    means = picked.select(key, "rep", c("_i").alias(i)).join(rows.select(key, i, value), [key, i]).groupBy(key, "rep").agg(F.avg(value).alias("m"))
    return bands(means, [key])


def adaptive_threshold(autocorrelation: Column, n: Column) -> Column:
    """How well a feature may go with the next return, by its own memory (T14; fixed values)."""
    a = F.abs(F.coalesce(autocorrelation, F.lit(0.0)))
    return F.when(n < 200, 0.95).when(a > 0.98, 0.99).when(a > 0.9, 0.97).when(a > 0.7, 0.95).otherwise(0.90)


def lookahead_scan(long: DataFrame, key: list[str], window: int = 500, step: int = 100, shuffles: int = 20, least_z: float = 5.0) -> DataFrame:
    """key, corr, threshold, leaking_windows, z, suspicious for each feature (T14). long: key, i (number in time order), x, nxt (next return).

    A feature is suspicious if its correlation with the next return is beyond its threshold, or beyond 0.98 in any stepped window, or
    least_z deviations beyond those of shuffled orders while above a tenth. A shuffle pairs the i-th row with the i-th by a
    seeded hash: two numberings and an equal join, no sort of all rows in one task when series are many."""
    order = Window.partitionBy(*key).orderBy("i")
    base = long.withColumn("_before", F.lag("x").over(order))
    whole = base.groupBy(*key).agg(correlation("x", "nxt").alias("corr"), correlation("x", "_before").alias("_ac"), F.count(F.when(c("x").isNotNull() & c("nxt").isNotNull(), 1)).alias("_n"))
    first, last = F.greatest(F.floor((c("i") - window) / step) + 1, F.lit(0)), F.floor(c("i") / step)
    many = long.withColumn("_w", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    each = many.groupBy(*key, "_w").agg(correlation("x", "nxt").alias("_k"), F.count(F.when(c("x").isNotNull() & c("nxt").isNotNull(), 1)).alias("_m"))
    stepped = each.filter("_m >= 50").groupBy(*key).agg(F.count_if(F.abs("_k") > 0.98).alias("leaking_windows"))
    valid = long.filter("x is not null and nxt is not null").withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
    own = valid.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_s").orderBy("i"))).select(*key, "_s", "_r", "nxt")
    mixed = valid.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_s").orderBy(F.xxhash64("i", "_s"), "i"))).select(*key, "_s", "_r", "x")
    chance = own.join(mixed, [*key, "_s", "_r"]).groupBy(*key, "_s").agg(F.abs(correlation("x", "nxt")).alias("_c"))
    chance = chance.groupBy(*key).agg(F.avg("_c").alias("_mean"), F.stddev_pop("_c").alias("_dev"))
    out = whole.join(stepped, key, "left").join(chance, key, "left")
    z = (F.abs("corr") - c("_mean")) / (c("_dev") + 1e-10)
    out = out.withColumns({"threshold": adaptive_threshold(c("_ac"), c("_n")), "leaking_windows": F.coalesce("leaking_windows", F.lit(0)), "z": z})
    beyond = (F.abs("corr") > c("threshold")) | (c("leaking_windows") > 0) | ((c("z") > least_z) & (F.abs("corr") > 0.1))
    return out.select(*key, "corr", "threshold", "leaking_windows", "z", F.coalesce(beyond, F.lit(False)).alias("suspicious"))


def clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, cluster: the smallest node that each is joined to, by labels that spread along edges (a, b) till none changes."""
    both = kept(edges.select("a", "b").union(edges.select(c("b").alias("a"), c("a").alias("b"))).distinct())
    now = kept(nodes.select("node", c("node").alias("cluster")))
    while True:
        near = both.join(now, c("b") == c("node")).groupBy("a").agg(F.min("cluster").alias("_near"))
        new = kept(now.join(near, c("node") == c("a"), "left").select("node", F.least("cluster", F.coalesce("_near", "cluster")).alias("cluster"), c("cluster").alias("_was")))
        changed = not new.filter("cluster <> _was").isEmpty()
        now = new.select("node", "cluster")
        if not changed:
            return now


def off_policy(rows: DataFrame, key: list[str], target: Column, logged: Column, reward: Column, model: Column, clip: float = 10.0) -> DataFrame:
    """key, n, ips, ips_std, snips, doubly_robust: what the target policy would earn, from rows of the logged one.

    target, logged: chances of the row's action under each; model: the reward that a model foretells. Weights are clipped."""
    w = F.least(F.greatest(target / F.greatest(logged, F.lit(1e-6)), F.lit(0.0)), F.lit(clip))
    x = rows.select(*key, w.alias("_w"), reward.alias("_r"), model.alias("_q"))
    wr = c("_w") * c("_r")
    return x.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(wr).alias("ips"), F.stddev_pop(wr).alias("ips_std"), (F.sum(wr) / F.sum("_w")).alias("snips"),
        F.avg(c("_q") + c("_w") * (c("_r") - c("_q"))).alias("doubly_robust"),
    )


def impact(size: Column, daily_volume: Column, vol: Column, factor: float = 1.0) -> Column:
    """Square-root market impact: factor * vol * sqrt(size / daily volume)."""
    return factor * vol * F.sqrt(F.greatest(size / F.greatest(daily_volume, F.lit(1e-9)), F.lit(0.0)))


def slippage_law(fills: DataFrame, key: list[str], slip: Column, share: Column, session: Column, urgency: Column, session_factors: Mapping[str, float], urgency_factors: Mapping[str, float]) -> DataFrame:
    """key, slope, intercept, n, and predicted: the law log(slip) = intercept + slope * log(share), fitted on fills freed of their
    session and urgency factors, and its mean prediction with them (T25). Rows whose slip or share isn't above 0 don't count."""
    table = lambda m, x: F.coalesce(F.create_map(*[v for k, f in m.items() for v in (F.lit(k), F.lit(f))])[x], F.lit(1.0))
    factor = table(session_factors, session) * table(urgency_factors, urgency)
    x = fills.select(*key, F.log(slip / factor).alias("_y"), F.log(share).alias("_x"), factor.alias("_f")).filter("_y is not null and _x is not null")
    fit = x.groupBy(*key).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count(F.lit(1)).alias("n"))
    told = x.join(fit, key).groupBy(*key).agg(F.avg(F.exp(c("intercept") + c("slope") * c("_x")) * c("_f")).alias("predicted"))
    return fit.join(told, key)
