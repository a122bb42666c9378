"""The corpus pipeline: drop toxic text, deduplicate, decontaminate, mix sources, shard.

Every stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the documents
of the next stage.  All but the last return the columns of the documents.

Rows without an id pass every stage on the strength of their own text; what
happens to null, empty, long and repeated texts is what the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertweft.llm import kdtree, mixing, simhash, templates, toxicity
from alertweft.llm.common import table
from alertweft.session import materialise, prepare

#: the dominant source is brought down to a fifth of the bytes; the others share the rest as they are
WEIGHTS, REST = {"src0": 0.2}, 0.8
SHARDS = 16


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 by classifiers fitted on this table and its labels."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of texts with four fifths of their five-word shingles in common."""
    return simhash.drop_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark, verbatim or re-parameterised."""
    return templates.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its Poisson draw says, shuffled."""
    return mixing.replicate(docs, WEIGHTS, REST, plain=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, shards of equal bytes."""
    return kdtree.shard_documents(docs, shards=SHARDS)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: trained classifiers have no SQL form; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents, each on what the one before has written."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
