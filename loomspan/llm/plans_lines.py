"""Queries of the problem of repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.boilerplate import repeated_lines, without_lines
from loomspan.operators.latest import latest_row
from loomspan.sources.tables import table


def _descriptions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "videos").filter(F.col("video_id").isNotNull()).select("video_id", "channel_id", "description", "last_updated")
    order = [F.col(c).desc_nulls_last() for c in ("last_updated", "channel_id", "description")]
    one = latest_row(rows, ["video_id"], order)
    return one.select(F.col("video_id").alias("doc"), F.col("channel_id").alias("source"), F.col("description").alias("text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that stand in five or more videos of the same channel."""
    return repeated_lines(_descriptions(spark, folder)).select(F.col("doc").alias("video_id"), "line_no")


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Each description without its channel's repeated lines."""
    documents = _descriptions(spark, folder)
    return without_lines(documents, repeated_lines(documents)).select(F.col("doc").alias("video_id"), F.col("text").alias("description"), "removed")


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}

_FOUND = r"""
WITH one AS (
  SELECT video_id, channel_id, description FROM videos WHERE video_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY last_updated DESC NULLS LAST, channel_id DESC NULLS LAST, description DESC NULLS LAST) = 1),
lines AS (
  SELECT video_id, channel_id, generate_subscripts(string_split(description, chr(10)), 1) - 1 AS line_no, unnest(string_split(description, chr(10))) AS line
  FROM one),
keyed AS (SELECT *, replace(replace(lower(upper(regexp_replace(line, '[^\p{L}\p{N}]+', '', 'g'))), 'ß', 'ss'), 'ς', 'σ') AS k FROM lines),
hits AS (SELECT channel_id, k FROM keyed WHERE channel_id IS NOT NULL AND k <> '' GROUP BY ALL HAVING count(DISTINCT video_id) >= 5),
found AS (SELECT video_id, CAST(line_no AS INTEGER) AS line_no FROM keyed SEMI JOIN hits USING (channel_id, k))
"""

ORACLE = {
    "p2_found": _FOUND + "SELECT * FROM found",
    "p2_clean": _FOUND
    + """, kept AS (
  SELECT k.video_id, string_agg(CASE WHEN f.line_no IS NULL THEN line END, chr(10) ORDER BY k.line_no) AS description, count(f.line_no)::INTEGER AS removed
  FROM keyed k LEFT JOIN found f ON f.video_id = k.video_id AND f.line_no = k.line_no GROUP BY k.video_id)
SELECT one.video_id, CASE WHEN one.description IS NULL THEN NULL ELSE coalesce(kept.description, '') END AS description, coalesce(removed, 0) AS removed
FROM one LEFT JOIN kept USING (video_id)""",
}
