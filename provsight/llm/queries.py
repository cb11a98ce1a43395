"""The queries of this subpackage: each applies its operator to the whole table, and derives digest columns from it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontam, licences, lines, passages, quality, resample, revisit, simhash, tokens, toxicity, wrapper
from .common import table
from .oracles import ORACLES


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item, with the tiles' coverage."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(*columns)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that have near copies and runs that have copies, with the one that stays."""
    return passages.repeated_spans(table(spark, sf_dir, "documents"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages resolved; headers as text, sorted by name."""
    out = revisit.resolve_revisits(revisit.capture_records(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "url_key", "ts", "status", "response_id", "candidate_id", text.alias("headers"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_files(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_decontamination, op2_quality_rules, op3_repeated_passages, op4_revisits, op5_line_dedup, op6_main_text, op7_token_counts, op8_bpe_round_trip, op9_licences, op10_simhash, op11_toxicity, op12_importance_resampling, op13_filter_audit, pipeline)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
