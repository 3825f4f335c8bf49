"""The corpus pipeline: stages that each write a table the next one reads.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codexlake.llm import decontaminate, line_dedup, packing, quality, simhash
from codexlake.sources.scratch import written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive limits of their language and source keep."""
    return quality.keep_good(_documents(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share; the largest doc_id keeps them. n_chars is counted anew; a null text becomes empty."""
    found = line_dedup.dedup_lines(_documents(docs), carry=("lang", "source"))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return simhash.drop_near_duplicates(_documents(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.remove_leaks(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack_documents(_documents(docs), TOKENIZER, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL has no tokenizer and no SimHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
