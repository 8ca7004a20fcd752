"""The corpus pipeline: toxicity, quality rules, near copies, mixing and packing, each stage on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder and rereads it as the next one's docs. All but the last return the columns of documents.

Defined cases, for every stage: an empty table stays empty; rows with null doc_id, lang or source are judged like
others; extra columns pass through all but the last; very long texts are read whole. A null or empty text has the
score of the intercept alone (toxicity), fails the base rules (quality rules), links with nothing (near copies),
has size 0 (mixing) and is its end id (packing). Repeated rows are judged alike; near copies keeps one of them, and mixing
repeats rows, each as a row of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import mixing, ngram_join, packing, quality, toxicity
from tidewatch.llm.common import cut, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier does not reject. It is fitted on labelled rows of docs."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that pass the base rules and are no outlier of their language and source."""
    return quality.keep_regular(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near copies."""
    return ngram_join.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), spare=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]
#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
