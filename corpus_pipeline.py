"""The corpus pipeline: documents in, packed batches of a deduplicated, mixed corpus out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what a stage returns is written
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize
from orderlines.llm.length_packing import pack
from orderlines.llm.line_dedup import dedup_lines
from orderlines.llm.near_texts import near_links
from orderlines.llm.quality_rules import keep_good
from orderlines.llm.simhash import keep_first, near_duplicates
from orderlines.llm.source_mix import mix_sources, take, words_in
from orderlines.llm.texts import read, small_batches


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits on repetition."""
    small_batches(spark)
    return keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document has; documents left without a word go.

    ``n_chars`` follows the text.
    """
    small_batches(spark)
    cut = dedup_lines(docs.select("doc_id", "text", "lang", "source"))
    whole = cut.where((F.col("n_deleted") == 0) | (words_in(F.col("text")) > 0))
    return whole.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id.

    Near are texts whose fingerprints differ in at most 4 bits, or that share four fifths of their
    five-word shingles.
    """
    small_batches(spark)
    grouped = near_duplicates(docs, keep=tuple(docs.columns), links=near_links(docs))
    return keep_first(grouped).select(*docs.columns)


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, in shards, shuffled."""
    return take(mix_sources(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, length, bucket, bucket_length, batch, slot, padding), one per copy."""
    lengths = materialize(docs.select("doc_id", words_in(F.col("text")).alias("n_words")), "lengths")
    return pack(lengths, "n_words").drop("n_words")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("source_mix", source_mix_stage),
    ("packing", packing_stage),
]

#: Suffix arrays, alignment, SimHash components and hash draws are beyond SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
