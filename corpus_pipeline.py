"""From raw documents to packed training sequences, in five stages over whole tables.

quality rules -> toxicity -> near-duplicates -> mixing -> packing. Every stage takes (spark, docs,
sf_dir), reads all that the stage before it kept, and its result is written and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evalgrid.llm import mixing, outliers, packing, simhash, toxicity
from evalgrid.llm.common import DOCUMENT_COLUMNS, bucket_of
from evalgrid.session import cut_lineage

TOXIC_FROM = 0.7
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are outliers of their language and source."""
    return outliers.drop_outliers(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic. The field learns from labels of rows whose crc32 modulo
    3 is not 1, on the documents of this stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.learn_chain(docs, labels, bucket_of(labels["doc_id"], 3) != 1)
    return toxicity.drop_toxic(docs, chain, TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target wants it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    return packing.pack(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The trained field and the tokenizer have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
