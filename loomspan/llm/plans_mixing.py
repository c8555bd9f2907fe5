"""Queries of the mixing problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.mixing import mix
from loomspan.sources.tables import table


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their copies."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each source, wanted and reached."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


QUERIES = {"p9_selection": p9_selection, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
