"""Contracts, gates, splits and the catalogue of features."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import kept


def c(name: str) -> Column:
    return F.col(name)


@dataclass
class Contract:
    """What a table must be: rules are data, and all of them are one pass over the table."""

    name: str
    types: dict[str, str]
    not_null: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    invariants: dict[str, str] = field(default_factory=dict)
    null_share: dict[str, float] = field(default_factory=dict)
    class_share: dict[str, tuple[list, float]] = field(default_factory=dict)
    unique: list[str] = field(default_factory=list)
    least_rows: int = 0

    def rules(self, without: list[str]) -> dict[str, Column]:
        """Each rule and when a row breaks it, but for rules on columns that are absent or of another type."""
        out = {f"not_null:{x}": c(x).isNull() for x in self.not_null if x not in without}
        out |= {f"bounds:{x}": ~c(x).between(a, b) for x, (a, b) in self.bounds.items() if x not in without}
        out |= {f"allowed:{x}": ~c(x).isin(v) for x, v in self.allowed.items() if x not in without}
        usable = {k: e for k, e in self.invariants.items() if not set(re.findall(r"\w+", e)) & set(without)}
        return out | {f"invariant:{k}": ~F.expr(e) for k, e in usable.items()}

    def missing(self, df: DataFrame) -> list[str]:
        """Columns that are absent or of another type."""
        have = dict(df.dtypes)
        return [x for x, t in self.types.items() if have.get(x) != t]

    def check(self, df: DataFrame) -> DataFrame:
        """rule, violations: a row for each rule."""
        missing = self.missing(df)
        rules = self.rules(missing)
        n = F.count(F.lit(1))
        whole = {f"null_share:{x}": F.coalesce(F.avg(c(x).isNull().cast("int")) > most, F.lit(False)) for x, most in self.null_share.items() if x in df.columns}
        for x, (classes, least) in self.class_share.items():
            if x in df.columns:
                whole |= {f"class_share:{x}={v}": F.coalesce(F.avg((c(x) == v).cast("int")) < least, F.lit(True)) for v in classes}
        if self.least_rows:
            whole["least_rows"] = n < self.least_rows
        rows = {k: F.count_if(F.coalesce(r, F.lit(False))) for k, r in rules.items()} | {k: r.cast("long") for k, r in whole.items()}
        counts = df.agg(n.alias("rows"), *[r.alias(k) for k, r in rows.items()])
        if self.unique and not set(self.unique) - set(df.columns):
            key = "unique:" + ",".join(self.unique)
            more = df.groupBy(*self.unique).count().agg(F.coalesce(F.sum(c("count") - 1), F.lit(0)).alias(key))
            counts, rows = counts.join(F.broadcast(more)), {**rows, key: None}
        found = [F.struct(F.lit(k).alias("rule"), c(f"`{k}`").cast("long").alias("violations")) for k in rows]
        found += [F.struct(F.lit(f"schema:{x}").alias("rule"), F.lit(1).cast("long").alias("violations")) for x in missing]
        return counts.select(F.explode(F.array(*found)).alias("p")).select("p.*")


def tick_contract(symbols: list[str] | None = None, price: tuple[float, float] = (1e-9, 1e9), ts: str = "timestamp_ntz") -> Contract:
    """Quotes: bounds of prices and the allowed symbols are the caller's."""
    return Contract(
        "tick", {"symbol": "string", "ts": ts, "bid": "double", "ask": "double", "mid": "double", "spread": "double", "volume": "double"},
        ["symbol", "ts", "bid", "ask"], {"mid": price, "volume": (0.0, 1e9)}, {"symbol": symbols} if symbols else {}, {"uncrossed": "bid < ask", "mid_inside": "mid between bid and ask"},
    )


def bar_contract(price: tuple[float, float] = (1e-9, 1e9), ts: str = "timestamp_ntz") -> Contract:
    return Contract(
        "bar", {"symbol": "string", "ts": ts, "open": "double", "high": "double", "low": "double", "close": "double"}, ["symbol", "ts", "close"], {"close": price}, {},
        {"high_is_highest": "high >= greatest(open, close)", "low_is_lowest": "low <= least(open, close)"},
    )


def feature_contract(bounds: dict[str, tuple[float, float]], most_null: float = 0.05, ts: str = "timestamp_ntz", key: tuple[str, ...] = ("symbol", "ts")) -> Contract:
    """Features: numbers inside their bounds, finite, seldom null, one row for each symbol and time."""
    finite = {f"finite_{x}": f"{x} is null or (not isnan({x}) and abs({x}) < double('infinity'))" for x in bounds}
    return Contract("feature", {"symbol": "string", "ts": ts, **{x: "double" for x in bounds}}, list(key), bounds, {}, finite, {x: most_null for x in bounds}, unique=list(key))


def label_contract(classes: tuple[int, ...] = (-1, 0, 1), least_share: float = 0.01, ts: str = "timestamp_ntz", exit_ts: str | None = None) -> Contract:
    """Labels: known classes, none all but missing, an exit after the entry."""
    later = {"exit_after_entry": f"{exit_ts} is null or {exit_ts} > ts"} if exit_ts else {}
    return Contract("label", {"symbol": "string", "ts": ts}, ["symbol", "ts", "label"], {}, {"label": list(classes)}, later, {}, {"label": (list(classes), least_share)}, ["symbol", "ts"])


def dataset_contract(features: list[str], label: str, least_rows: int = 1000, most_null: float = 0.0) -> Contract:
    """A training table: enough rows, no repeats, every feature and the label there."""
    return Contract("dataset", {x: "double" for x in features}, [label], null_share={x: most_null for x in features}, unique=["symbol", "ts"], least_rows=least_rows)


def gates(df: DataFrame, least_rows: int, null_share: float, columns: list[str]) -> DataFrame:
    """gate, value, passed for row count and null shares."""
    n = F.count(F.lit(1))
    one = df.agg(n.cast("double").alias("row_count"), *[F.avg(c(x).isNull().cast("int")).alias(f"nulls:{x}") for x in columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("gate"), c(f"`{x}`").alias("value")) for x in one.columns])).alias("g")).select("g.*")
    return rows.withColumn("passed", F.when(c("gate") == "row_count", c("value") >= least_rows).otherwise(c("value") <= null_share))


def drift_gate(both: DataFrame, columns: list[str], is_live: Column, most: float = 0.2) -> DataFrame:
    """gate, value, passed: the stability index of each column of the live rows against the reference rows."""
    from tidemark.operators.stats import long_form, psi

    long = long_form(both.withColumn("_is_live", is_live).select("_is_live", *[c(x).cast("double").alias(x) for x in columns]), ["_is_live"], columns)
    out = psi(long, "x", ["feature"], c("_is_live"))
    return out.select(F.concat(F.lit("drift:"), "feature").alias("gate"), c("psi").alias("value"), (c("psi") <= most).alias("passed"))


def lookahead_gate(scan: DataFrame, name: Column) -> DataFrame:
    """gate, value, passed from the rows of a look-ahead scan."""
    return scan.select(F.concat(F.lit("lookahead:"), name).alias("gate"), F.abs("corr").alias("value"), (~c("suspicious")).alias("passed"))


def contract_gate(df: DataFrame, contract: Contract) -> DataFrame:
    """gate, value, passed: how many violations of all rules."""
    total = contract.check(df).agg(F.sum("violations").cast("double").alias("value"))
    return total.select(F.lit(f"contract:{contract.name}").alias("gate"), "value", (c("value") == 0).alias("passed"))


def report(results: dict[str, DataFrame]) -> DataFrame:
    """part, gate, passed, value, failures and level from the gate rows of several tables (G7): each gate at level 0, each part's
    sum at 1, the whole at 3. A part passes if all its gates do."""
    every = None
    for part, df in results.items():
        one = df.select(F.lit(part).alias("part"), "gate", "value", "passed")
        every = one if every is None else every.unionByName(one)
    out = every.rollup("part", "gate").agg(F.bool_and("passed").alias("passed"), F.max("value").alias("value"), F.count_if(~c("passed")).alias("failures"), F.grouping_id().alias("level"))
    return out.withColumn("value", F.when(c("level") == 0, c("value")))


def quality_checks(bars: DataFrame, widest: float = 0.035, columns: tuple[str, ...] = (), alike: float = 0.99) -> DataFrame:
    """check, count: rows against each quality check, and columns without variance, of one value, and pairs of columns that go together.

    columns: those that the last three look at."""
    from tidemark.operators.stats import correlation

    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("id"))
    same = F.count(F.lit(1)).over(Window.partitionBy("symbol", "ts"))
    marks = {
        "null_close": c("close").isNull(),
        "not_finite": F.isnan("close") | (F.abs("close") == float("inf")),
        "duplicate_ts": c("_same") > 1,
        "not_monotonic": c("_before") > c("ts"),
        "weekend": F.weekday("ts") >= 5,
        "crossed": c("bid_close") >= c("ask_close"),
        "wide_spread": c("spread") > widest,
        "bad_ohlc": (c("high") < F.greatest("open", "close")) | (c("low") > F.least("open", "close")),
        "flat": c("high") == c("low"),
    }
    total = lambda parts: sum((F.coalesce(p, F.lit(False)).cast("long") for p in parts), F.lit(0).cast("long"))
    pairs = list(itertools.combinations(columns, 2))
    whole = {
        "low_variance": total(F.stddev_samp(x) < 1e-9 for x in columns),
        "constant": total(F.min(x) == F.max(x) for x in columns),
        "alike": total(F.abs(correlation(a, b)) > alike for a, b in pairs),
    }
    counts = [F.count_if(F.coalesce(m, F.lit(False))).alias(k) for k, m in marks.items()] + ([x.alias(k) for k, x in whole.items()] if columns else [])
    counted = bars.withColumns({"_before": before, "_same": same}).agg(*counts)
    return counted.unpivot([], [*marks, *(whole if columns else [])], "check", "count")


def remedied(df: DataFrame, steps: list[tuple], key: str = "symbol", ts: str = "ts") -> DataFrame:
    """df after each remedy in turn (G5): (drop_nulls, columns), (forward_fill, columns), (zero_fill, columns), (interpolate, columns),
    (winsorise, columns, low, high), (clip, columns, deviations), (dedupe,), (cap_spread, column, times the median), (repair_bars,), (no_weekends,).

    Bounds are each key's own. Interpolation is by time between the nearest values on both sides."""
    order = Window.partitionBy(key).orderBy(ts)

    def bounded(df: DataFrame, columns: list[str], low, high) -> DataFrame:
        by = df.groupBy(key).agg(*[f(x).alias(f"_{side}_{x}") for x in columns for side, f in (("low", low), ("high", high))])
        joined = df.join(by, key)
        held = {x: F.when(c(x).isNotNull(), F.greatest(F.least(c(x), c(f"_high_{x}")), c(f"_low_{x}"))) for x in columns}
        return joined.withColumns(held).select(*df.columns)

    for name, *rest in steps:
        if name == "drop_nulls":
            df = df.dropna(subset=rest[0])
        elif name == "zero_fill":
            df = df.fillna(0.0, subset=rest[0])
        elif name == "forward_fill":
            df = df.withColumns({x: F.last(x, ignorenulls=True).over(order) for x in rest[0]})
        elif name == "interpolate":
            at = F.unix_micros(c(ts).cast("timestamp"))
            back = order.rowsBetween(Window.unboundedPreceding, 0)
            ahead = Window.partitionBy(key).orderBy(c(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)  # in reverse: each row is read once
            for x in rest[0]:
                point = F.when(c(x).isNotNull(), F.struct(at.alias("t"), c(x).alias("v")))
                df = df.withColumns({"_a": F.last(point, ignorenulls=True).over(back), "_z": F.last(point, ignorenulls=True).over(ahead)})
                share = (at - c("_a.t")) / (c("_z.t") - c("_a.t"))
                df = df.withColumn(x, F.coalesce(c(x), c("_a.v") + share * (c("_z.v") - c("_a.v")))).drop("_a", "_z")
        elif name == "winsorise":
            df = bounded(df, rest[0], lambda x, q=rest[1]: F.percentile(x, q), lambda x, q=rest[2]: F.percentile(x, q))
        elif name == "clip":
            df = bounded(df, rest[0], lambda x, k=rest[1]: F.avg(x) - k * F.stddev_samp(x), lambda x, k=rest[1]: F.avg(x) + k * F.stddev_samp(x))
        elif name == "dedupe":
            df = df.dropDuplicates([key, ts])
        elif name == "cap_spread":
            df = bounded(df, [rest[0]], lambda x: F.min(x), lambda x, k=rest[1]: k * F.percentile(x, 0.5))
        elif name == "repair_bars":
            df = df.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})
        elif name == "no_weekends":
            df = df.filter(F.weekday(ts) < 5)
        else:
            raise ValueError(f"no remedy {name}")
    return df


def schema_drift(old: dict[str, str], df: DataFrame) -> DataFrame:
    """column, change: added, removed or of another type (G6). The rows are a table's columns."""
    now = dict(df.dtypes)
    rows = [(x, "removed" if x not in now else "added" if x not in old else "type") for x in sorted(old.keys() | now.keys()) if old.get(x) != now.get(x)]
    return df.sparkSession.createDataFrame(rows, "column string, change string")


def numbered(df: DataFrame, order: list[str], cell: Column) -> DataFrame:
    """row: each row's number from 0 in the whole order, by cell counts and places within cells; no single task counts all."""
    df = df.withColumn("_cell", cell)
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("_cell").count()
    counts = counts.select("_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("n"))
    nth = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    return df.join(counts, "_cell").withColumn("row", c("_before") + nth).drop("_cell", "_before")


def walk_forward(df: DataFrame, folds: int, first: float, step: float, purge: int) -> DataFrame:
    """fold, row and role: each fold trains on what is before its validation rows, less the last purge rows.

    df has row and n. A row has a role in few folds, made by a fixed list: no join."""
    roles = []
    for k in range(folds):
        a, b = F.floor(c("n") * (first + step * k)), F.least(F.floor(c("n") * (first + step * (k + 1))), c("n"))
        role = F.when(c("row") < a - purge, "train").when((c("row") >= a) & (c("row") < b), "validate")
        roles.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    return df.withColumn("_r", F.explode(F.array(*roles))).select("*", "_r.fold", "_r.role").drop("_r").filter("role is not null")


def combinatorial(df: DataFrame, groups: int, test: int, purge: int) -> DataFrame:
    """fold, row and role over every choice of test groups among groups (G9): train rows stand purge rows off any test group."""
    size = F.ceil(c("n") / groups)
    own = F.floor(c("row") / size)
    roles = []
    for k, chosen in enumerate(itertools.combinations(range(groups), test)):
        near = [(c("row") >= g * size - purge) & (c("row") < (g + 1) * size + purge) for g in chosen]
        close = near[0]
        for x in near[1:]:
            close = close | x
        roles.append(F.struct(F.lit(k).alias("fold"), F.when(own.isin(*chosen), "test").when(~close, "train").alias("role")))
    return df.withColumn("_r", F.explode(F.array(*roles))).select("*", "_r.fold", "_r.role").drop("_r").filter("role is not null")


def purged_kfold(df: DataFrame, folds: int, embargo: int) -> DataFrame:
    """As combinatorial with one test group, and the embargo on both sides."""
    return combinatorial(df, folds, 1, embargo)


def three_way(df: DataFrame, train: float, validate: float, embargo: int) -> DataFrame:
    """row and role: train, validate and test in time order, embargo rows left out after each of the first two (G10). df has row and n."""
    a, b = F.floor(c("n") * train), F.floor(c("n") * (train + validate))
    role = F.when(c("row") < a, "train").when((c("row") >= a + embargo) & (c("row") < b), "validate").when(c("row") >= b + embargo, "test")
    return df.withColumn("role", role).filter("role is not null")


def online(df: DataFrame, first: int | Column, size: int | Column, folds: int, embargo: int, window: int | Column | None = None) -> DataFrame:
    """fold, row and role: each fold is tested on the next size rows and trains on all before, or the last window of them, less embargo.

    first, size and window are rows, or columns, such as shares of n."""
    roles = []
    for k in range(folds):
        a = first + k * size
        low = 0 if window is None else a - embargo - window
        role = F.when((c("row") >= low) & (c("row") < a - embargo), "train").when((c("row") >= a) & (c("row") < a + size), "test")
        roles.append(F.struct(F.lit(k).alias("fold"), role.alias("role")))
    return df.withColumn("_r", F.explode(F.array(*roles))).select("*", "_r.fold", "_r.role").drop("_r").filter("role is not null")


def split_report(df: DataFrame, target: str, ts: str = "ts") -> DataFrame:
    """fold, train and other rows, their target means, the gap in rows between them, whether any row number lies in both."""
    train = c("role") == "train"
    by = df.groupBy("fold").agg(
        F.count_if(train).alias("train"), F.count_if(~train).alias("other"), F.avg(F.when(train, c(target))).alias("train_mean"), F.avg(F.when(~train, c(target))).alias("other_mean"),
        F.max(F.when(train, c("row"))).alias("_last"), F.min(F.when(~train, c("row"))).alias("_first"),
    )
    both = df.groupBy("fold", "row").agg(F.count_distinct("role").alias("_k")).groupBy("fold").agg(F.count_if(c("_k") > 1).alias("shared"))
    return by.join(both, "fold").select("fold", "train", "other", "train_mean", "other_mean", (c("_first") - c("_last") - 1).alias("gap"), "shared")


LINEAGE = "run string, stage string, output string, inputs array<string>, rows long, hash string, seconds double"


def lineage_record(df: DataFrame, run: str, stage: str, output: str, inputs: list[str], seconds: float = 0.0) -> DataFrame:
    """One lineage row of a stage's output, with its row count and fingerprint (G13); append it to the lineage table."""
    return fingerprint(df).select(
        F.lit(run).alias("run"), F.lit(stage).alias("stage"), F.lit(output).alias("output"), F.array(*map(F.lit, inputs)).cast("array<string>").alias("inputs"),
        "rows", "hash", F.lit(float(seconds)).alias("seconds"),
    )


def lineage_chain(records: DataFrame, output: str) -> DataFrame:
    """output, depth, stage, rows: what an output was made from, directly or not; sources that no stage made have no stage."""
    edges = records.select(c("output").alias("node"), F.explode("inputs").alias("needs"))
    made = records.select(c("output").alias("node"), "stage", "rows")
    return ancestors(edges, [output]).join(made, "node", "left").select(c("node").alias("output"), "depth", "stage", "rows")


def ancestors(edges: DataFrame, start: list[str] | DataFrame) -> DataFrame:
    """node, depth: what the start nodes depend on, directly or not, and by how many steps at least (G12, G13); edges: node, needs.

    Each round goes one step on from the nodes that the last one found and leaves out those that were reached before, so
    cycles and many ways to a node do no harm, and there is no greatest depth. start: names, or a table with a column node."""
    edges = kept(edges.select("node", "needs").distinct())
    if isinstance(start, list):
        start = edges.sparkSession.createDataFrame([(s,) for s in start], "node string")
    found, reached, depth = start.select("node").distinct(), None, 0
    while True:
        depth += 1
        step = edges.join(found, "node", "left_semi").select(c("needs").alias("node")).filter("node is not null").distinct()
        if reached is not None:
            step = step.join(reached, "node", "left_anti")
        found = kept(step.withColumn("depth", F.lit(depth)))
        if found.isEmpty():
            return reached if reached is not None else found
        reached = found if reached is None else reached.unionByName(found)
        if depth % 10 == 0:
            reached = kept(reached)


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and an order-free hash of all of them (F8, G18): the same rows give the same number however they are dealt."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).cast("string").alias("hash"))


def parity(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], within: float = 1e-5) -> DataFrame:
    """column, largest difference, passed: two tables by key."""
    other = b.select(*key, *[c(x).alias(f"_{x}") for x in columns])
    most = a.join(other, key).agg(*[F.max(F.abs(c(x) - c(f"_{x}"))).alias(x) for x in columns])
    return most.unpivot([], columns, "column", "worst").withColumn("passed", c("worst") <= within)
