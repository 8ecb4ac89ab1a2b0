"""Operators that fit something: mixtures, factors, Granger tests, gates, topics; fits see the past only."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import LDA, GaussianMixture
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Roll, lag, series
from tidemark.operators.scans import exponential_mean


def c(name: str) -> Column:
    return F.col(name)


def windows_at(df: DataFrame, x: str, n: int, step: int) -> DataFrame:
    """symbol, ts, w: the last n values at every step-th row."""
    at = df.withColumns({"_i": F.row_number().over(series()), "w": F.collect_list(x).over(Roll(n).window)})
    return at.filter((F.size("w") == n) & (c("_i") % step == 0)).select("symbol", "ts", "w")


def fluctuation(df: DataFrame, x: str, n: int = 64, step: int = 8, boxes: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """Detrended fluctuation exponent of each window: residuals of the summed series about a line in each box."""

    def cut(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n // k - 1)), lambda j: F.struct(F.lit(k).alias("k"), F.slice("walk", j * k + 1, F.lit(k)).alias("v")))

    w = windows_at(df, x, n, step)
    mean = F.aggregate("w", F.lit(0.0), lambda s, v: s + v) / n
    w = w.withColumn("_m", mean)
    walk = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0.0), lambda s, v: s + v) - i * c("_m"))
    rows = w.withColumn("walk", walk).select("symbol", "ts", F.explode(F.flatten(F.array(*map(cut, boxes)))).alias("b")).select("symbol", "ts", "b.k", "b.v")
    total = lambda f: F.aggregate(F.transform("v", f), F.lit(0.0), lambda s, y: s + y)
    k, mid = c("k"), (c("k") - 1) / 2
    sxx = k * (k * k - 1) / 12
    sy, sxy, syy = total(lambda y: y), total(lambda y, i: y * (i - mid)), total(lambda y: y * y)
    rows = rows.withColumn("_r", F.greatest(syy - sy * sy / k - sxy * sxy / sxx, F.lit(0.0)))
    by = rows.groupBy("symbol", "ts", "k").agg(F.sqrt(F.sum("_r") / F.sum("k")).alias("f")).filter("f > 1e-12")
    return by.groupBy("symbol", "ts").agg(F.regr_slope(F.log("f"), F.log("k")).alias("dfa"))


def fractal_dimension(df: DataFrame, x: str, n: int = 64, step: int = 8, most: int = 6) -> DataFrame:
    """Higuchi's dimension of each window from curve lengths at strides 1 to most, within 1 and 2."""
    w = windows_at(df, x, n, step)

    def moves(m: int, k: int, steps: int) -> Column:
        at = lambda i: F.element_at("w", (i * k + m + 1).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda s, i: s + F.abs(at(i) - at(i - 1)))

    def length(k: int) -> Column:
        parts = []
        for m in range(k):
            steps = (n - 1 - m) // k
            parts.append(moves(m, k, steps) * ((n - 1) / (steps * k)) / k)
        return sum(parts, F.lit(0.0)) / k

    lengths = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), length(k).alias("len")) for k in range(1, most + 1)]))
    rows = w.select("symbol", "ts", lengths.alias("l")).select("symbol", "ts", "l.k", "l.len").filter("len > 0")
    slope = rows.groupBy("symbol", "ts").agg(F.regr_slope(F.log("len"), F.log("k")).alias("s"))
    return slope.select("symbol", "ts", F.least(F.greatest(-c("s"), F.lit(1.0)), F.lit(2.0)).alias("fractal_dimension"))


def segment_dimension(df: DataFrame, x: str, n: int = 30) -> DataFrame:
    """Dimension of each window of n rows from the mean moves over segments of 1 to n / 2 - 1 rows, each from the window's start on, within 1 and 2."""
    w = windows_at(df, x, n, 1)

    def length(k: int) -> Column:
        starts = range(0, n - k, k)
        moves = [F.abs(c("w")[j + k] - c("w")[j]) for j in starts]
        return sum(moves[1:], moves[0]) / len(starts) * (n - 1) / (len(starts) * k * k)

    lengths = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), length(k).alias("len")) for k in range(1, n // 2)]))
    rows = w.select("symbol", "ts", lengths.alias("l")).select("symbol", "ts", "l.k", F.greatest("l.len", F.lit(1e-12)).alias("len"))
    slope = rows.groupBy("symbol", "ts").agg(F.regr_slope(F.log("len"), F.log("k")).alias("s"))
    return slope.select("symbol", "ts", F.least(F.greatest(-c("s"), F.lit(1.0)), F.lit(2.0)).alias("segment_dimension"))


def mixture_regime(df: DataFrame, features: list[str], until: Column, k: int = 3) -> DataFrame:
    """Probabilities of the components of a Gaussian mixture fitted on the rows before a cut, lagged by a bar."""
    rows = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(df)
    model = GaussianMixture(featuresCol="_v", predictionCol="_p", probabilityCol="_q", k=k, seed=7).fit(rows.filter(until))
    out = model.transform(rows).withColumn("_q", vector_to_array("_q"))
    return out.select("symbol", "ts", *[lag(c("_q")[i]).alias(f"regime_{i}_prob") for i in range(k)])


def common_factors(panel: DataFrame, names: list[str], n: int = 60, step: int = 20) -> DataFrame:
    """Share of variance of the leading common factors and the first one's loadings, at every step-th time from the last n.

    panel: ts and a column for each name. Windows become sums of products by grouped aggregation; only the small
    matrix of each refit is decomposed in Python, with the largest loading positive."""
    numbered = panel.withColumn("_i", F.row_number().over(Window.orderBy("ts")))  # one row for each time, not for each tick
    last = numbered.agg(F.max("_i").alias("m"))
    low, high = F.greatest(F.ceil(c("_i") / step), F.lit(n // step)) * step, F.least(F.ceil((c("_i") + n - step) / step), F.floor(c("m") / step)) * step
    fits = F.when(low <= high, F.sequence(low, high, F.lit(step).cast("long")))
    at = numbered.join(F.broadcast(last), F.lit(True)).withColumn("fit", F.explode(fits))
    at = at.filter((c("_i") <= c("fit")) & (c("_i") > c("fit") - n))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    cov = at.groupBy("fit").agg(F.max(F.struct("_i", "ts")).alias("end"), *[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                m = np.zeros((len(names), len(names)))
                for a, b in pairs:
                    i, j = names.index(a), names.index(b)
                    m[i, j] = m[j, i] = r[f"{a}|{b}"]
                values, vectors = np.linalg.eigh(m)
                v = vectors[:, -1]
                v = v * np.sign(v[np.abs(v).argmax()])
                out.append((r["ts"], float(values[-1] / values.sum()), float(values[-2] / values.sum()), v.tolist()))
            yield pd.DataFrame(out, columns=["ts", "share_1", "share_2", "loadings"])

    return cov.select(c("end.ts").alias("ts"), *[c(f"`{a}|{b}`") for a, b in pairs]).mapInPandas(decompose, "ts timestamp_ntz, share_1 double, share_2 double, loadings array<double>")


def granger(returns: DataFrame) -> DataFrame:
    """F statistic for one lag of a adding to one lag of b in predicting b, for each ordered pair, by sums."""
    own = returns.withColumns({"y1": lag("r")}).select(c("symbol").alias("b"), "ts", c("r").alias("y"), "y1")
    theirs = returns.select(c("symbol").alias("a"), "ts", lag("r").alias("x1"))
    j = own.join(theirs, "ts").filter("a <> b").dropna()
    cov = lambda p, q: F.covar_pop(p, q)
    s = j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *[cov(p, q).alias(p + q) for p, q in (("y", "y"), ("y", "y1"), ("y", "x1"), ("y1", "y1"), ("y1", "x1"), ("x1", "x1"))])
    short = c("yy") - c("yy1") * c("yy1") / c("y1y1")
    det = c("y1y1") * c("x1x1") - c("y1x1") * c("y1x1")
    b1, b2 = (c("yy1") * c("x1x1") - c("yx1") * c("y1x1")) / det, (c("yx1") * c("y1y1") - c("yy1") * c("y1x1")) / det
    long = c("yy") - b1 * c("yy1") - b2 * c("yx1")
    return s.select("a", "b", ((short - long) / (long / (c("n") - 3))).alias("f"))


def expanding_gate(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """A logistic score for each row by a model fitted on all blocks before its own (W74); df has a column block from 0, in time order.

    Every block after the first that has rows is scored; there is a fit for each, as the rows before it differ."""
    rows = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(df)
    blocks = sorted(r[0] for r in rows.select("block").distinct().collect())
    if len(blocks) < 2:
        return rows.limit(0).select(*df.columns, F.lit(0.0).alias("gate"))
    out = None
    for b in blocks[1:]:
        model = LogisticRegression(featuresCol="_v", labelCol=target, regParam=0.01, maxIter=20).fit(rows.filter(c("block") < b))
        scored = model.transform(rows.filter(c("block") == b)).select(*df.columns, vector_to_array("probability")[1].alias("gate"))
        out = scored if out is None else out.unionByName(scored)
    return out


def logistic_score(x: Column, middle: float, scale: float) -> Column:
    """A gate between 0 and 1 where there is nothing to fit one on."""
    return 1 / (1 + F.exp(-(x - middle) / scale))


def gate_weights(p: Column) -> dict[str, Column]:
    """The weights of three sources at a gate's value (W74; fixed values)."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return {"gold": unit(0.2 + 0.8 * p), "yield": unit(1 - 0.7 * p), "risk": unit(0.3 + 0.7 * p)}


def separability(df: DataFrame, features: list[str], is_live: Column) -> DataFrame:
    """AUC of a small forest that tells live rows from reference rows, on rows that it was not fitted on."""
    rows = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(df.withColumn("label", is_live.cast("double")))
    odd = F.pmod(F.xxhash64(*features), F.lit(2)) == 1
    model = RandomForestClassifier(featuresCol="_v", labelCol="label", numTrees=10, maxDepth=4, seed=7).fit(rows.filter(odd))
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(model.transform(rows.filter(~odd)))
    return df.sparkSession.createDataFrame([(float(auc),)], "auc double")


def topics(texts: DataFrame, k: int = 4, terms: int = 2000) -> DataFrame:
    """Topic weights of each text by LDA over its weighted words."""
    words = RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"[^\p{L}]+").transform(texts)
    counts = CountVectorizer(inputCol="_w", outputCol="_c", vocabSize=terms, minDF=2).fit(words).transform(words)
    weighted = IDF(inputCol="_c", outputCol="_f").fit(counts).transform(counts)
    model = LDA(featuresCol="_f", k=k, maxIter=5, seed=7).fit(weighted)
    return model.transform(weighted).select("doc_id", *[vector_to_array("topicDistribution")[i].alias(f"topic_{i}") for i in range(k)])


def long_ema(df: DataFrame, x: str, span: int) -> DataFrame:
    """The exponential mean of long series (A14), as an affine scan over buckets of rows.

    df has symbol, ts, and bucket and row as numbers in the symbol's order."""
    return exponential_mean(df.select("symbol", "ts", "row", "bucket", x), x, span, ["symbol"], ["row"], "bucket").select("symbol", "ts", "ema")


def black_delta(spot: Column, strike: Column, vol: Column, years: Column) -> Column:
    """Call delta under Black's model."""
    from tidemark.operators.stats import normal_cdf

    return normal_cdf((F.log(spot / strike) + vol * vol / 2 * years) / (vol * F.sqrt(years)))


