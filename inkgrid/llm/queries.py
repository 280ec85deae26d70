"""Queries of the llm operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkgrid.llm import bpe, langid, lookalike, mixing, pairs, repetition, sentences, truncation
from inkgrid.session import spread, table


def _models(spark: SparkSession, d: str):
    return langid.models_for(spark, table(spark, d, "documents"), table(spark, d, "regions"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(spread(table(spark, d, "regions")), _models(spark, d))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.segment_languages(spread(table(spark, d, "regions")), _models(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "regions"))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_forms(table(spark, d, "regions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_regions(spread(table(spark, d, "regions")))


def p3_feed_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.feed_shares(spread(table(spark, d, "regions")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(spread(table(spark, d, "regions")))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.shares(spread(table(spark, d, "regions")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(spread(table(spark, d, "regions")), table(spark, d, "pages"), table(spark, d, "volumes"), _models(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(spread(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unreachable(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(spread(table(spark, d, "documents")), table(spark, d, "mix_targets")).select("doc_id", "source", "uses")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.actual_shares(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return sentences.sentence_table(docs, sentences.fit(docs))


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return sentences.sentence_units(docs, sentences.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
