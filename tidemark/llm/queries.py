"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_codec, chat_format, decontaminate, exact_dedup, hard_negatives, language_id, lexical, quality, sharding, simhash, suffix_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_bpe_codec": bpe_codec.op5_bpe_codec,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality": quality.op8_quality,
    "op9_language_id": language_id.op9_language_id,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_lexical": lexical.op11_lexical,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_sharding": sharding.op13_sharding,
}

SQL: dict[str, str] = {**chat_format.SQL, **exact_dedup.SQL, **lexical.SQL, **hard_negatives.SQL, **sharding.SQL}
