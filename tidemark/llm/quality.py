"""Document quality by hierarchical empirical Bayes.

A logistic regression over a few measures of a whole text gives each document its own evidence. Each host, and each
path prefix of a host, has a posterior share of good documents: counts of labelled good and labelled rows, joined by
the classifier's probabilities of all its documents at a weight (soft), are added up by grouped aggregation; a path is
shrunk towards its host and a host towards the global share by the strengths (host_strength, path_strength) that the
method of moments gives from how much groups differ beyond chance. A group with few rows thus stays near its parent. A
document's quality is its own log odds, moved by as much as its path's posterior log odds differ from the global ones.

Documents that a crawled page belongs to (the number at the end of the page's path) take host and path from its URL;
others have their source as host and path. Hosts and paths are aggregated before any join, so a hot host costs no more
than another.

Defined cases: a null or empty text has all measures 0; null hosts count as one host; without labels all evidence is
even (0.5). Labels of one document are combined by their least. A null label or id doesn't teach. Long texts are
read whole; repeated rows get a result each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, fold, salted_join, table, text_of, unit_hash
from tidemark.llm.linear import logistic

MEASURES = ["log_bytes", "upper", "digit", "symbol", "space", "sentence", "repeated_lines", "word_bytes", "repeated_words"]


def byte_classes() -> np.ndarray:
    kinds = np.zeros((256, 5))
    for b in range(128):
        c = chr(b)
        kinds[b] = [c.isupper(), c.isdigit(), not (c.isalnum() or c.isspace() or c in ".,;:!?'\"()-"), c.isspace(), c in ".!?"]
    return kinds


def measures(text: str, kinds: np.ndarray) -> list[float]:
    """What is measured of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(MEASURES)
    n = len(data)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ kinds / n
    lines = [x for x in data.split(b"\n") if x]
    words = data.split()
    return [
        float(np.log1p(n)) / 10,
        *share.tolist(),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(n / max(1, len(words)), 50) / 10,
        1 - len(set(words)) / len(words) if words else 0.0,
    ]


def measured(docs: DataFrame, by: list[str]) -> DataFrame:
    """The columns of by, and array m of measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = byte_classes()
        for batch in batches:
            m = pa.array([measures(t.as_py(), kinds) for t in batch.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], m], [*by, "m"])

    schema = docs.select(*by).schema.add("m", T.ArrayType(T.DoubleType()))
    return docs.select(text_of("text").alias("text"), *by).mapInArrow(run, schema)


def fit(rows: DataFrame, bound: int) -> tuple[list[float], float]:
    """Weights over the measures and bias, from a sample of at most about bound of the labelled rows (m, quality, doc_id)."""
    n = rows.count()
    sample = rows.filter(unit_hash("doc_id") < bound / max(1, n)).select("doc_id", "m", "quality").limit(2 * bound).toPandas().sort_values(["doc_id", "quality"])
    if sample.quality.nunique() < 2:
        return [0.0] * len(MEASURES), 0.0
    x = np.array(sample.m.tolist())
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w, b = logistic((x - mean) / scale, sample.quality.to_numpy(float), l2=1e-3)
    return (w / scale).tolist(), float(b - (w / scale) @ mean)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, good: str, n: str, parent: Column) -> float:
    """How many rows a parent's share counts for, by the method of moments: large where groups differ no more than by chance."""
    r = groups.agg(
        F.sum(F.col(n)).alias("n"),
        F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - parent, 2)).alias("q"),
        F.sum(parent * (1 - parent)).alias("v"),
        F.sum(F.col(n) * parent * (1 - parent)).alias("nv"),
    ).first()
    if not r["n"] or not r["nv"]:
        return 1.0
    spread = (r["q"] - r["v"]) / r["n"]  # the variance between groups beyond that of their rows
    return float(min(max(r["nv"] / r["n"] / max(spread, 1e-9) - 1, 1.0), 1e4))


def quality_scores(docs: DataFrame, sites: DataFrame, labels: DataFrame, learn_from: Column, soft: float = 0.05, bound: int = 20_000) -> DataFrame:
    """docs: doc_id, text, source; sites: doc_id, host, path, one row each. Texts are measured where they are read, before any join. Gives doc_id, host, path, evidence, host_posterior, path_posterior, quality for each row."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).filter(learn_from)
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    kept = measured(docs, ["doc_id", "source"]).join(sites, "doc_id", "left").join(known, "doc_id", "left")
    kept = cut(kept.withColumn("host", F.coalesce("host", "source")).withColumn("path", F.coalesce("path", F.lit("/"))))
    weights, bias = fit(kept.filter(F.col("quality").isNotNull()), bound)
    z = F.lit(bias) + sum((F.col("m")[i] * w for i, w in enumerate(weights)), F.lit(0.0))
    rows = kept.select("doc_id", "host", "path", "quality", (1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))))).alias("evidence"))

    good = F.sum(F.coalesce(F.col("quality").cast("double"), soft * F.col("evidence")))
    n = F.sum(F.when(F.col("quality").isNotNull(), 1.0).otherwise(soft))
    paths = rows.groupBy("host", "path").agg(good.alias("path_good"), n.alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    total = hosts.agg(F.sum("host_good").alias("g"), F.sum("host_n").alias("n")).first()
    share = min(max(total["g"] / total["n"], 1e-3), 1 - 1e-3) if total["n"] else 0.5
    k = strength(hosts, "host_good", "host_n", F.lit(share))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("host_good") + k * share) / (F.col("host_n") + k)).alias("host_posterior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k = strength(paths, "path_good", "path_n", F.col("host_posterior"))
    paths = paths.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "host_posterior",
        ((F.col("path_good") + k * F.col("host_posterior")) / (F.col("path_n") + k)).alias("path_posterior"),
    )
    moved = logit(F.col("evidence")) + logit(F.col("path_posterior")) - float(np.log(share / (1 - share)))
    met = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    return salted_join(rows, paths, met, ["doc_id", "evidence"]).select(
        "doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", (1 / (1 + F.exp(-moved))).alias("quality")
    )


def page_sites(pages: DataFrame) -> DataFrame:
    """doc_id, host, path of the documents that have a page: the number that ends a URL's path is the document's id.

    Of several pages of a document the one with the smallest page_id counts."""
    url = F.col("url")
    at = F.struct(
        "page_id",
        F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract(url, r"^[a-z]+://[^/?#]+(/[^/?#]*/)", 1).alias("path"),
    )
    number = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/(?:[^?#]*/)?(\d+)(?:\.html?)?/?(?:[?#].*)?$", 1).try_cast("bigint")
    found = pages.select(number.alias("doc_id"), at.alias("at")).filter(F.col("doc_id").isNotNull())
    return found.groupBy("doc_id").agg(F.min("at").alias("at")).select("doc_id", "at.host", "at.path")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(
        table(spark, sf_dir, "documents"), page_sites(table(spark, sf_dir, "pages")), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0
    )
    return scored.withColumn("held_out", fold("doc_id", 5) == 0).withColumn("keep", F.col("quality") >= 0.5)
