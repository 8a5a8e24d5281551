"""Queries of the text problems (p6 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.harmful import rates, score_documents
from ridgeline.llm.leakage import find_leaks
from ridgeline.llm.mixing import mix
from ridgeline.session import ship, table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Test items and the documents that hold a stretch of either of their texts."""
    ship(spark)
    leaks = find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", ["item_text", "ref_text"])
    return leaks.select("item_id", "doc_id").distinct()


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their repeats."""
    ship(spark)
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mix reaches."""
    ship(spark)
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score."""
    ship(spark)
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "doc_reviews"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the classifier finds harmful."""
    return p8_scores(spark, folder).filter("harmful").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The share of harmful documents of each source."""
    return rates(p8_scores(spark, folder))


QUERIES = {"p6_found": p6_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
