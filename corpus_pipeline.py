"""From raw documents to token files: quality filter, near-dedup, decontamination, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, whatever other columns there are. The last writes token files and reads them back:
the table it returns has a row for each document of the files.

Null texts are empty texts in all stages. Rows without doc_id are scored, kept by the near-dedup, tested for test items,
mixed and encoded like others. Rows that are repeated stay repeated, but for the mix, which takes each row by its own
rank. Texts of any length are read whole. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, mixing, quality, similar, tokens
from lexiloom.llm.common import materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of its training fold, scores 0.3 or more; without usable labels all score 0.5 and stay."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles of similarity 0.8 or more), that of the smallest doc_id.

    Copies are found by the Golay keys of SimHash fingerprints, and by min-hash bands where fingerprints differ too much;
    their sets of shingles verify each link. Texts without words are copies of each other; rows without doc_id stay.
    """
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark, whole or edited; items of fewer than three words or without id test nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null sources are one source."""
    return mixing.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token files."""
    return tokens.encode_table(docs, tokens.tokenizer_path()).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-ID output", encoding),
]

#: Neither the classifier nor the tokenizer is SQL; tests/llm compares each stage and run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
