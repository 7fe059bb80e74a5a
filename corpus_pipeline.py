"""Corpus pipeline: language ID, line dedup, near-dedup, mixing and packing over the documents table.

Every stage takes what its predecessor kept, as a Parquet table in the shared scratch folder, and its
decisions take effect; a predecessor's table is deleted once its successor is written. All but the last return
the columns of ``documents`` in their order.

Defined results: documents with a NULL, empty or letterless text have no recognised language and go in the first stage;
a text that line dedup empties stays as an empty document, near-duplicate of all other empty ones; rows with a
NULL doc_id are kept like others (last where ids decide); of rows equal in all columns one stays after
near-dedup; extra columns, whatever their names, travel along until packing. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import langid, line_dedup, mixing, packing, simhash
from lamina.llm.text_columns import column
from lamina.scratch import drop_path, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones and those without a letter go."""
    return langid.recognised(docs, langid.fit(docs.where(langid.remainder("doc_id", 4) != 2)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three-line windows go from the texts; n_chars follows."""
    cut = line_dedup.dedup_lines(docs, counts=False)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*map(column, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks."""
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Language ID, SimHash and tokenizing cannot be expressed in SQL; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        if before:
            drop_path(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)  # written by the packing stage itself, before this returns
    drop_path(spark, before)
    return packed
