"""Exact dedup by content-defined chunk recipes, with DataFrame operations only.

A text is lower-cased (A-Z only) and cut where its own content says so: after the first sentence end or line break at
256 characters or more, at 16384 characters at the latest. Every distinct chunk gets an identifier, 128 bits of
its SHA-256, which counts only once it is verified: the chunks under one identifier are compared as strings, and the
query fails if any two differ. A document is then its recipe, the ordered list of identifiers, and documents are equal
when recipes are. The text itself moves once, as chunks that are combined on the map side; all other shuffles carry
identifiers. No chunk is a key that documents are joined by, so one that many share is no hot key. The filter keep_one
decides on identifiers too; documents stay where they lie if the list of those to drop is short enough to broadcast.

Defined cases: a null text counts as empty, and empty texts are equal to each other (their recipe is the empty list).
Repeated rows are documents of their own, of which one is kept. A null id is smaller than any id. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, ascii_lower, cut, small, table, text_of

#: A chunk ends at the first of these marks past the least size; without one it ends at the largest size.
CHUNK = r"(?s).{255,16383}?[.!?\n]|.{1,16384}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: str = CHUNK) -> DataFrame:
    """One row for each distinct (id, text): doc_id, text_sha256, recipe (ordered verified chunk ids), copies (rows)."""
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(text_col)).alias("norm"))
    parts = norm.select("doc_id", "norm", F.regexp_extract_all("norm", F.lit(chunk), F.lit(0)).alias("chunks"))
    digest = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
    # each distinct chunk moves once; a digest with two contents stops the query
    doubtful = (
        parts.select(F.explode("chunks").alias("chunk"))
        .groupBy(digest(F.col("chunk")).alias("digest"), "chunk")
        .agg(F.lit(1).alias("one"))
        .groupBy("digest")
        .agg(F.count("one").alias("contents"))
        .agg(F.count_if(F.col("contents") > 1).alias("doubtful"))
    )
    listed = (
        parts.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.transform("chunks", digest).alias("digests"))
        .groupBy("doc_id", "sha", "digests")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    failed = F.raise_error(F.lit("two chunks share one digest")).cast("array<binary>")
    recipe = F.when(F.col("doubtful") == 0, F.col("digests")).otherwise(failed)
    return listed.crossJoin(F.broadcast(doubtful)).select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), recipe.alias("recipe"), "copies")  # one row


def decided(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct (id, text): doc_id, text_sha256, copies, keep_id, group_size."""
    members = recipes(docs, id_col, text_col)
    groups = members.groupBy(F.col("recipe").alias("same")).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    joined = members.join(groups, F.col("recipe") == F.col("same"))
    return joined.select("doc_id", "text_sha256", "copies", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs; the largest id of equal texts stays."""
    found = decided(docs, id_col, text_col)
    return found.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), "copies")).alias("nth")).select(
        "doc_id",
        "keep_id",
        "group_size",
        # only where all ids of a group are null is there none to keep by: such a group keeps one row
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact dedup keeps, with all their columns.

    A row that repeats, id and text alike, stays once."""
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    told = decided(docs, id_col, text_col).filter(~stays | (F.col("copies") > 1))
    told = cut(told.select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest"), stays.alias("_once")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256)).alias("_sha"))
    own = F.col(f"_row.`{id_col}`")
    met = (F.col("_sha") == F.col("_digest")) & own.eqNullSafe(F.col("_id"))
    kept = rows.join(small(told), met, "left_anti")
    again = told.filter("_once")
    if not again.isEmpty():  # rows that repeat and stay: one of each
        nth = F.row_number().over(Window.partitionBy("_sha", "_id").orderBy("_sha"))
        kept = kept.unionByName(rows.join(small(again), met).withColumn("_nth", nth).filter("_nth = 1").select("_row", "_sha"))
    return kept.select("_row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t"""
}
