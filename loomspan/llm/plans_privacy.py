"""Queries of the problem of personal information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.privacy import find_personal_information, redact
from loomspan.llm.threads import latest_comments
from loomspan.sources.tables import table

_FIELDS = ("text_original", "author_display_name")


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    return latest_comments(table(spark, folder, "comments"), *_FIELDS)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of personal information in the comments and their authors' names."""
    return find_personal_information(_comments(spark, folder), key="comment_id", fields=_FIELDS)


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Both fields with placeholders."""
    return redact(_comments(spark, folder), key="comment_id", fields=_FIELDS)


QUERIES = {"p7_found": p7_found, "p7_redacted": p7_redacted}
ORACLE: dict[str, str] = {}
