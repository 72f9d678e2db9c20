"""A corpus, cleaned and encoded: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm import bpe, decontaminate, quality_rules, simhash, substring_dedup
from prosemill.llm.shared import checkpoint_dir, table

#: What SQL cannot say: hashed n-gram ratios, XXH64 fingerprints and BPE. The tests hold run() against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id. Of equal rows one stays."""
    key = next(k for k in (f"key{i}" for i in range(len(docs.columns) + 1)) if k not in docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    stay = simhash.near_duplicates(keyed, carry=[key]).filter("representative").select(key).distinct()
    once = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))
    kept = keyed.join(stay, key, "left_semi")
    return kept.withColumn(key, once).filter(F.col(key) == 1).select(_columns(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; ``n_chars`` follows the text."""
    out = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return found.filter("NOT contaminated").select(_columns(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what they write stays in the shared checkpoint folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
