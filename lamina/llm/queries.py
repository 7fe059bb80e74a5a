"""The registered queries of this subpackage: thin digests of each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import avi, html_extract, langid, line_dedup, mixing, packing, quality_mil, quality_rules, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "text", "n_units", "n_removed")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def _labelled(spark: SparkSession, sf_dir: str, label: str, folds: int, held: int) -> DataFrame:
    """Labelled documents outside the held-out fold, without any other column."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").where(langid.remainder("doc_id", folds) != held)
    return docs.join(_table(spark, sf_dir, "labels").select("doc_id", label).where(F.col(label).isNotNull()), "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = toxicity.fit(_labelled(spark, sf_dir, "toxic", 5, 0))
    scored = toxicity.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon)
    held_out = F.coalesce(langid.remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_mil.fit(_labelled(spark, sf_dir, "quality", 4, 2))
    scored = quality_mil.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    held_out = F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "host")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bangs", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted = mixing.count_copies(docs, keep=["doc_id"])
    return counted.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = langid.remainder("doc_id", 4)
    model = langid.fit(docs.where(fold != 2))
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), avi.media_features(avi.media_column(F.col("text"))).alias("f"))
    return stored.select("doc_id", "n_bytes", "f.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_simhash, op4_toxicity, op5_quality_mil, op6_html_extraction, op7_quality_rules, op8_mixing, op9_language_id, op10_avi_media)}


def oracle_sql() -> dict[str, str]:
    from lamina.llm import sql

    return {"op2_line_dedup": sql.LINE_DEDUP, "op7_quality_rules": sql.quality_rules_sql(), "op8_mixing": sql.mixing_sql()}
