"""A training-data pipeline over ``documents``; each stage's rows are written and read again by the next.

Stages decide on all rows that the stage before them kept, whole texts included:
toxic documents go; of equal texts, and then of each group of near duplicates
(five words, Jaccard 0.8), one document stays; sources are mixed to target
weights by replication; the copies are encoded. All stages but the last return
the columns of ``documents``; the last gives doc_id, source, n_tokens and ids of
every copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shuffleworks.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from shuffleworks.llm.common import cut, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return ngram_join.drop_near_copies(docs, width=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, in a random order."""
    return mixing.replicate(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every copy, which decode to its tokens' names."""
    encoded = bpe.encode(spark, docs, keep=["source"])
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", clean),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]

# A trained classifier and a tokenizer have no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
