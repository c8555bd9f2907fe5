"""Queries of the sentence problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.sentences import sentence_units, sentences
from loomspan.sources.tables import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where each sentence of each document begins."""
    return sentences(table(spark, folder, "documents"))


def p10_units(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences themselves."""
    return sentence_units(table(spark, folder, "documents"))


QUERIES = {"p10_found": p10_found, "p10_units": p10_units}
ORACLE: dict[str, str] = {}
