"""Queries of the conversation problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.threads import conversations, with_roles
from loomspan.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of every usable conversation, numbered."""
    return conversations(table(spark, folder, "comments"))


def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the role of each author and the text."""
    comments = table(spark, folder, "comments")
    return with_roles(conversations(comments), comments, table(spark, folder, "videos"))


QUERIES = {"p5_found": p5_found, "p5_conversations": p5_conversations}

_INVISIBLE = r"[\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}\x{FE00}-\x{FE0F}]"
_FOUND = rf"""
WITH RECURSIVE one AS (
  SELECT comment_id, video_id, published_at, total_reply_count, text_original, author_channel_id,
    CASE WHEN regexp_matches(parent_id, '[^\s\p{{Z}}]') THEN parent_id END AS parent
  FROM comments WHERE comment_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY last_seen DESC NULLS LAST) = 1),
tree AS (
  SELECT comment_id, comment_id AS thread, false AS flaw FROM one WHERE parent IS NULL
  UNION ALL
  SELECT c.comment_id, t.thread, coalesce(c.video_id <> p.video_id OR c.published_at < p.published_at, true)
  FROM tree t JOIN one c ON c.parent = t.comment_id JOIN one p ON p.comment_id = t.comment_id),
msgs AS (
  SELECT thread, t.comment_id, published_at,
    flaw OR published_at IS NULL OR regexp_replace(coalesce(text_original, ''), '{_INVISIBLE}+', '', 'g') = '' AS bad
  FROM tree t JOIN one USING (comment_id)),
ok AS (
  SELECT thread FROM msgs JOIN one top ON top.comment_id = thread
  GROUP BY thread HAVING NOT bool_or(bad) AND count(*) > 1 AND count(*) - 1 >= coalesce(max(top.total_reply_count), 0)),
found AS (
  SELECT thread AS thread_id, CAST(row_number() OVER (PARTITION BY thread ORDER BY published_at, comment_id) - 1 AS INTEGER) AS msg_no, comment_id
  FROM msgs SEMI JOIN ok USING (thread))
"""

ORACLE = {
    "p5_found": _FOUND + "SELECT * FROM found",
    "p5_conversations": _FOUND
    + """, own AS (
  SELECT video_id, channel_id FROM videos WHERE video_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY last_updated DESC NULLS LAST, channel_id DESC NULLS LAST) = 1)
SELECT thread_id, msg_no, found.comment_id, m.video_id,
  CASE WHEN m.author_channel_id = own.channel_id THEN 'owner' WHEN m.author_channel_id = t.author_channel_id THEN 'starter' ELSE 'other' END AS role,
  m.text_original AS text
FROM found JOIN one m ON m.comment_id = found.comment_id JOIN one t ON t.comment_id = thread_id LEFT JOIN own ON own.video_id = m.video_id""",
}
