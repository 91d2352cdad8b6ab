"""Queries of the training-data operators, over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm.canonical import collapsed, copies
from tallywright.llm.contamination import leaked_items
from tallywright.llm.crosssplit import cross_split_overlap
from tallywright.llm.neardup import near_duplicates
from tallywright.llm.packing import fill, oversized, pack, validity
from tallywright.llm.quality import judged, no_prose, statistics
from tallywright.llm.sampling import allocation, draw, unmet
from tallywright.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "eval_rows"), table(spark, d, "leakage_checks")).pairs()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "eval_rows"), table(spark, d, "leakage_checks")).groups()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_overlap(table(spark, d, "eval_rows"), table(spark, d, "leakage_checks")).flagged()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_overlap(table(spark, d, "eval_rows"), table(spark, d, "leakage_checks")).report()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unmet(table(spark, d, "eval_rows"), table(spark, d, "sample_targets"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return draw(table(spark, d, "eval_rows"), table(spark, d, "sample_targets"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return allocation(table(spark, d, "eval_rows"), table(spark, d, "sample_targets")).drop("key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(table(spark, d, "eval_rows"), table(spark, d, "predictions"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(table(spark, d, "eval_rows"), table(spark, d, "predictions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(table(spark, d, "documents"), table(spark, d, "pack_plans"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "pack_plans"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(table(spark, d, "documents"), table(spark, d, "pack_plans"))


def p6_validity(spark: SparkSession, d: str) -> DataFrame:
    return validity(table(spark, d, "documents"), table(spark, d, "pack_plans"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "test_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return no_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_distances(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "documents"), table(spark, d, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}
