"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing, SentencePiece encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import cols, scratch
from hydrospark.llm.exact_dedup import keep_first
from hydrospark.llm.mixing import mixed_rows
from hydrospark.llm.quality_rules import line_frequency
from hydrospark.llm.shingle_dedup import drop_near_copies, simhash_candidates
from hydrospark.llm.wfst import encode_pieces

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents; the others lose the lines above their host's limit."""
    out = line_frequency(docs, copies_once=True).filter("kept")
    return out.select(*cols(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose sets of five-word shingles have similarity 0.8 or more, over any number of steps, the row with the least doc_id stays.

    Operator 7 (SimHash with Golay keys) brings texts together, and so do MinHash buckets, since four bits reach few of the pairs near 0.8; the texts' whole sets decide on both.
    """
    return drop_near_copies(docs, candidates=simhash_candidates(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they give it back (a sign for a space comes back as a space)."""
    out = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over all documents; what a stage keeps is written in the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)


#: The stages hash and tokenise as SQL can't; tests hold them against brute force.
ORACLE_SQL = None
