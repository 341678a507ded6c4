"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents the one before kept, and returns a DataFrame; run() writes each
as Parquet to the shared folder and reads it again for the next. All but the last return the columns of documents.

The order that mixing gives to documents is that of the files it is written to and of the rows in them; packing reads it from there.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import minhash_dedup, quality_rules, secret_scan, sequence_packing, source_mixing
from loomwright.llm.common import materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject; cutoffs are proven on the labelled documents among docs."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return minhash_dedup.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets in texts are masked and n_chars follows."""
    return secret_scan.masked(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture's slots; a source that runs dry leaves its room to the others."""
    return source_mixing.mixture(docs)


def as_written(docs: DataFrame) -> Column:
    """A whole number that grows along the rows as they were written: the number of the file in the upper bits, the row's number in it in the lower 33. For what is no Parquet file, along the rows as they come."""
    try:
        file = docs.metadataColumn("_metadata")
        docs.select(file["row_index"])
    except AnalysisException:
        return F.monotonically_increasing_id()
    return F.shiftleft(F.coalesce(F.regexp_extract(file["file_name"], "part-([0-9]+)", 1).try_cast("long"), F.lit(0)), 33) + file["row_index"]


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences, which are numbered along the mixture."""
    return sequence_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), at=as_written(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_quality), ("near copies", without_near_copies), ("secrets", without_secrets), ("mixing", mixed_sources), ("packing", packed),
]

#: Token ids and the packing program are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
