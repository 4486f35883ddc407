"""From raw documents to token ids: identify, dedup, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of `documents`. Stages are written as Parquet and read again.

Defined results: a document without letters goes with the first stage; of equal texts the
one with the largest id stays, of near ones (five words, similarity of 0.8 or more) the one
with the smallest; a document that the mix repeats has that many rows from there on; an
empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgate.llm import byte_pairs, exact, language, mixing, near
from corpusgate.llm.common import table
from corpusgate.session import materialize


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language.keep_identified(docs, language.fit(docs.where(language.learnable(docs))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in proportion to the weights of their sources."""
    return mixing.draw_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    return byte_pairs.round_trip(docs, keep_ids=True)


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("near_dedup", drop_near),
          ("source_mix", mix), ("byte_pairs", encode)]

# The first stage is a trained model; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
