"""Prefix scans of recursions over long series: what each row makes of all rows before it, without one task a key.

A key's rows are dealt into cells in their order. Whatever a recursion does, a cell's rows together do to the state that they meet is one
element of an associative algebra; a key's elements are combined, and each cell goes on from the state it then starts with.

* running: sums, counts, least and greatest values up to each row, by window functions only.
* scan: any algebra that numpy can combine row by row. Cells' elements are combined in a tree, FAN at a time, so neither a
  cell nor a tree node holds more than a bounded number of rows however long a key is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
#: Elements that a node of the tree combines.
FAN = 1024
_PARTS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def running(df: DataFrame, key: list[str], order: list[str], cell: Column, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with, under each name, the sum, count, min or max of a column over the key's rows up to each one in order.

    cell: a function of the first order column that doesn't fall. Nulls are left out, as in Spark's aggregates; a null key is a key.
    Two passes: over the cells of a key, of which there is one narrow row each, and inside each cell."""
    of = {n: f"_of_{n}" for n in wanted}
    rows = df.withColumns({"_cell": cell} | {of[n]: x for n, (_, x) in wanted.items()})
    inside = Window.partitionBy(*key, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*[c(k).alias(f"_k{i}") for i, k in enumerate(key)], c("_cell").alias("_in")).agg(*[_PARTS[how](of[n]).alias(f"_end_{n}") for n, (how, _) in wanted.items()])
    again = lambda how: _PARTS["sum" if how == "count" else how]  # noqa: E731  counts of cells add up
    starts = ends.select(*[f"_k{i}" for i in range(len(key))], "_in", *[again(how)(f"_end_{n}").over(before).alias(f"_start_{n}") for n, (how, _) in wanted.items()])
    met = c("_cell").eqNullSafe(c("_in"))
    for i, k in enumerate(key):
        met &= c(k).eqNullSafe(c(f"_k{i}"))
    both = rows.withColumns({f"_upto_{n}": _PARTS[how](of[n]).over(inside) for n, (how, _) in wanted.items()}).join(starts, met)
    out = {}
    for n, (how, _) in wanted.items():
        a, b = c(f"_start_{n}"), c(f"_upto_{n}")
        out[n] = {"min": F.least, "max": F.greatest}[how](a, b) if how in ("min", "max") else F.coalesce(a + b, a, b)
    return both.select(*[c(f"`{x}`") for x in df.columns if x not in out], *[x.alias(n) for n, x in out.items()])


@dataclass(frozen=True)
class Algebra:
    """Elements are rows of numbers; combine takes two arrays of them, earlier ones first, and is associative; zero changes nothing."""

    zero: tuple[float, ...]
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def prefixes(self, e: np.ndarray) -> np.ndarray:
        """Each element combined with all before it, in as many steps as the number of elements has binary digits."""
        e, step = np.array(e, float), 1
        while step < len(e):
            e[step:] = self.combine(e[:-step].copy(), e[step:])
            step *= 2
        return e


#: State s becomes a s + b: exponential means.
AFFINE = Algebra((1.0, 0.0), lambda x, y: np.column_stack([x[:, 0] * y[:, 0], x[:, 1] * y[:, 0] + y[:, 1]]))
#: A sum and the least it has been, 0 included: how far a walk stands above its lowest point.
WALK = Algebra((0.0, 0.0), lambda x, y: np.column_stack([x[:, 0] + y[:, 0], np.minimum(x[:, 1], x[:, 0] + y[:, 1])]))


def starts(totals: DataFrame, key: list[str], algebra: Algebra, fan: int = FAN) -> DataFrame:
    """key, cell (a long, not negative) and start: the element of all earlier cells of the key. totals: key, cell, total.

    Levels of a tree: fan neighbouring cells are one node, whose own start comes from the level above."""
    fields = [totals.schema[k] for k in key]
    array = T.ArrayType(T.DoubleType())
    kind = T.StructType([*fields, T.StructField("cell", T.LongType()), T.StructField("node", T.LongType()), T.StructField("before", array), T.StructField("whole", array)])

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        upto = algebra.prefixes(np.stack(pdf.total.to_numpy()))
        before = np.vstack([np.array(algebra.zero), upto[:-1]])
        whole = [None] * (len(pdf) - 1) + [upto[-1].tolist()]  # a node's own total stands in its last row
        return pdf[[*key, "cell", "node"]].assign(before=before.tolist(), whole=whole)

    most = totals.agg(F.max("cell")).first()[0]
    inside = totals.select(*key, "cell", F.floor(c("cell") / fan).alias("node"), "total").groupBy(*key, "node").applyInPandas(level, kind)
    if most is None or most < fan:
        return inside.select(*key, "cell", c("before").alias("start"))
    above = starts(inside.filter("whole is not null").select(*key, c("node").alias("cell"), c("whole").alias("total")), key, algebra, fan)
    above = above.select(*[c(k).alias(f"_k{i}") for i, k in enumerate(key)], c("cell").alias("_node"), c("start").alias("_above"))
    met = c("node") == c("_node")
    for i, k in enumerate(key):
        met &= c(k).eqNullSafe(c(f"_k{i}"))
    join = F.pandas_udf(lambda a, b: pd.Series(list(algebra.combine(np.stack(a.to_numpy()), np.stack(b.to_numpy())))), array)
    return inside.join(above, met).select(*key, "cell", join("_above", "before").alias("start"))


def scan(df: DataFrame, key: list[str], order: list[str], cell: str, algebra: Algebra, lift: Callable[[pd.DataFrame], np.ndarray], out: dict[str, Callable[[np.ndarray], np.ndarray]], fan: int = FAN) -> DataFrame:
    """df with a column for each name in out, made of the element of all rows up to each one.

    cell: a long column, not negative, that doesn't fall in the key's order; lift gives the elements of sorted rows."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf[[*key, cell]].iloc[:1].rename(columns={cell: "cell"}).assign(total=[algebra.prefixes(lift(pdf))[-1].tolist()])

    def go_on(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        e = lift(rows)
        if len(start):  # each row's own prefix, with what came before the cell
            e = np.vstack([np.array(start.start.iloc[0], float), e])
        upto = algebra.prefixes(e)[len(e) - len(rows) :]
        return rows.assign(**{n: f(upto) for n, f in out.items()})

    fields = [df.schema[k] for k in key]
    kind = T.StructType([*fields, T.StructField("cell", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])
    totals = df.groupBy(*key, cell).applyInPandas(whole, kind)
    begin = starts(totals, key, algebra, fan).withColumnRenamed("cell", cell)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in out]])
    return df.groupBy(*key, cell).cogroup(begin.groupBy(*key, cell)).applyInPandas(go_on, schema)


def exponential_mean(df: DataFrame, x: str, span: int, key: list[str], order: list[str], cell: str, name: str = "ema", fan: int = FAN) -> DataFrame:
    """df with the exponential mean of x, which starts at the first value of a key; nulls leave it as it is."""
    a = 2 / (span + 1)

    def lift(pdf: pd.DataFrame) -> np.ndarray:
        v = pdf[x].to_numpy(float, na_value=np.nan)
        return np.where(np.isnan(v)[:, None], (1.0, 0.0), np.column_stack([np.full(len(v), 1 - a), a * np.nan_to_num(v)]))

    # the first value counts whole: as if the mean had stood there before, which is the weight the start still has
    first = df.filter(c(x).isNotNull()).groupBy(*key).agg(F.min_by(x, F.struct(*order)).alias("_first"))
    firsts = first.select(*[c(k).alias(f"_k{i}") for i, k in enumerate(key)], "_first")
    met = F.lit(True)
    for i, k in enumerate(key):
        met &= c(k).eqNullSafe(c(f"_k{i}"))
    done = scan(df, key, order, cell, AFFINE, lift, {"_keep": lambda e: e[:, 0], "_in": lambda e: e[:, 1]}, fan)
    told = done.join(F.broadcast(firsts), met, "left")  # a row for each key
    return told.select(*[c(f"`{n}`") for n in df.columns if n != name], F.when(c("_keep") < 1, c("_in") + c("_keep") * c("_first")).alias(name))
