"""The registered queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, canonical, mixing, neighbours, pairs, reading, split, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(table(spark, sf_dir, "kb_index_chunks"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_chunks(table(spark, sf_dir, "kb_index_chunks"))


def _truncation(spark: SparkSession, sf_dir: str) -> truncation.Truncation:
    return truncation.Truncation(
        [
            ("questions", table(spark, sf_dir, "questions"), "question_id", "question_text", "ingest_source"),
            ("kb_index_chunks", table(spark, sf_dir, "kb_index_chunks"), "id", "text", "ingest_source"),
        ]
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncation(spark, sf_dir).found()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncation(spark, sf_dir).report()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "kb_index_chunks"))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "kb_index_chunks"), "cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 100 = 0")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(pairs.pairs_of(table(spark, sf_dir, "questions"), table(spark, sf_dir, "kb_entries")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.mapped(table(spark, sf_dir, "kb_documents"), table(spark, sf_dir, "doc_ref"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).rows()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")).select("doc_id", "level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p4_found": p4_found,
    "p4_nearest": p4_nearest,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p9_found": p9_found,
}

SQL: dict[str, str] = {
    "p1_found": r"""SELECT DISTINCT id AS chunk_id FROM kb_index_chunks
        WHERE id IS NOT NULL AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1100""",
}
