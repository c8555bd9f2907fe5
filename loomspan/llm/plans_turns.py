"""Queries of the transcript problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.turns import speaker_turns
from loomspan.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of every transcript."""
    return speaker_turns(table(spark, folder, "transcripts"), table(spark, folder, "speakers"), with_text=False)


def p4_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The turns with their text."""
    return speaker_turns(table(spark, folder, "transcripts"), table(spark, folder, "speakers"))


QUERIES = {"p4_found": p4_found, "p4_turns": p4_turns}
ORACLE: dict[str, str] = {}
