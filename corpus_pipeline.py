"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), and the next reads what it wrote.

Whole texts go to Python workers in short Arrow batches; the session keeps that setting.
Columns beside those of documents go along through the filtering stages. Empty tables, nulls, repeated rows and texts of
any length are as each stage's operator has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_codec, decontaminate, exact_dedup, language_id, simhash
from tidemark.llm.common import checkpoint_dir, remove, short_batches, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those that no learned language fits."""
    short_batches(spark)
    return language_id.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate groups the row with the smallest id stays: fingerprints and bands of minima name candidates, which exact similarity verifies."""
    short_batches(spark)
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs."""
    short_batches(spark)
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, as counts and digests, with those of the decoded texts."""
    import public_tokenizers

    short_batches(spark)
    return bpe_codec.digests(bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: The classifier, the fingerprints' components and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared checkpoint folder and read again."""
    folder = checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        out = f"{folder}/stage-{n}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if n:
            remove(spark, f"{folder}/stage-{n - 1}")  # what follows reads the newer one
    return docs
