"""The corpus pipeline: quality rules, language ID, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last keep the documents' columns.

Defined results, stage by stage (the operators' docstrings say more)
* a null, empty or blank text has no words: quality rules reject it; handed to the later stages all the same, language ID
  rejects it (no letter), exact dedup counts null as empty and keeps one, near-dedup keeps the one with the smallest id,
  packing gives it one piece, its end id;
* rows with a null id are judged by quality rules and language ID like any other; in exact dedup they lose against any
  id; near-dedup leaves them alone; repeated rows are copies of each other;
* an empty table stays empty through all stages; columns of other names pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinetrail.llm.common import read, stage
from kinetrail.llm.exact_dedup import exact_dedup
from kinetrail.llm.language_id import language_filter, train
from kinetrail.llm.packing import pack
from kinetrail.llm.quality_rules import quality_filter
from kinetrail.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_filter(docs, train(docs, public_tokenizers.path("piece_bpe_32k.model")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the executors' memory is still filled by the stages before
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=0.15)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("packing", packing),
]

#: Language ID, SimHash and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
    return docs
