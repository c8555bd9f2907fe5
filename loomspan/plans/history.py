"""Queries of the history and snapshot problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.ledger import bitemporal_ledger, clean_count, clean_title, hot_entities, versions
from loomspan.operators.snapshots import snapshot_changes
from loomspan.sources.tables import table

_TIME = "yyyy-MM-dd HH:mm:ss"


def _channels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "channels").select(
        F.lit("channel").alias("entity"),
        F.col("channel_id").alias("entity_id"),
        F.col("last_updated").alias("valid_at"),
        F.col("received_at").alias("seen_at"),
        clean_count(F.col("subscriber_count")).alias("subscriber_count"),
    )


def _videos(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "video_updates").select(
        F.lit("video").alias("entity"),
        F.col("video_id").alias("entity_id"),
        F.col("last_updated").alias("valid_at"),
        F.col("received_at").alias("seen_at"),
        clean_title(F.col("title")).alias("title"),
        clean_count(F.col("view_count")).alias("view_count"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of a channel's subscriber count and of a video's title and views."""
    parts = []
    for seen, values in ((_channels(spark, folder), ["subscriber_count"]), (_videos(spark, folder), ["title", "view_count"])):
        hot = hot_entities(seen)
        parts.append(versions(bitemporal_ledger(seen, values=values, hot=hot), values=values, hot=hot))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select(
        "entity",
        "entity_id",
        F.date_format("valid_from", _TIME).alias("valid_from"),
        F.coalesce(F.date_format("valid_to", _TIME), F.lit("open")).alias("valid_to"),
    )


def p3_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The whole bitemporal ledger: superseded statements with the time they were believed."""
    parts = [bitemporal_ledger(_channels(spark, folder), values=["subscriber_count"]), bitemporal_ledger(_videos(spark, folder), values=["title", "view_count"])]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select(
        "entity", "entity_id", "subscriber_count", "view_count", "title", "valid_from", "valid_to", "recorded_from", "recorded_to"
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Playlists added, removed or changed between consecutive snapshots."""
    changes = snapshot_changes(table(spark, folder, "playlists"), key="playlist_id", snapshot="snapshot_date", content="items", version="last_updated")
    return changes.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "playlist_id", "change")


QUERIES = {"p3_found": p3_found, "p3_ledger": p3_ledger, "p6_found": p6_found}

_OBSERVED = r"""
obs AS (
  SELECT 'channel' AS entity, channel_id AS entity_id, last_updated AS t, received_at AS r,
         subscriber_count AS c, CAST(NULL AS VARCHAR) AS title
  FROM channels
  UNION ALL
  SELECT 'video', video_id, last_updated, received_at, view_count, title FROM video_updates),
clean AS (
  SELECT entity, entity_id, t, r,
    TRY_CAST(CASE WHEN regexp_matches(regexp_replace(c, '[\s,\x{A0}\x{2000}-\x{200A}\x{202F}]+', '', 'g'), '^[0-9]+$')
      THEN regexp_replace(c, '[\s,\x{A0}\x{2000}-\x{200A}\x{202F}]+', '', 'g') END AS HUGEINT)::VARCHAR AS c,
    NULLIF(regexp_replace(title, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'), '') AS title
  FROM obs WHERE entity_id IS NOT NULL AND t IS NOT NULL)"""

ORACLE = {
    "p3_found": f"""
WITH {_OBSERVED},
one AS (
  SELECT * FROM clean
  QUALIFY row_number() OVER (PARTITION BY entity, entity_id, t ORDER BY r DESC NULLS LAST, title DESC NULLS LAST, c DESC NULLS LAST) = 1),
filled AS (
  SELECT entity, entity_id, t,
    last_value(c IGNORE NULLS) OVER w AS c, last_value(title IGNORE NULLS) OVER w AS title
  FROM one WINDOW w AS (PARTITION BY entity, entity_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
marked AS (
  SELECT *, row_number() OVER w AS n, lag(c) OVER w AS c0, lag(title) OVER w AS title0
  FROM filled WINDOW w AS (PARTITION BY entity, entity_id ORDER BY t)),
begun AS (SELECT * FROM marked WHERE n = 1 OR c IS DISTINCT FROM c0 OR title IS DISTINCT FROM title0)
SELECT entity, entity_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS valid_from,
  coalesce(strftime(lead(t) OVER (PARTITION BY entity, entity_id ORDER BY t), '%Y-%m-%d %H:%M:%S'), 'open') AS valid_to
FROM begun""",
    "p3_ledger": f"""
WITH {_OBSERVED},
one AS (
  SELECT entity, entity_id, t, coalesce(r, TIMESTAMP '-infinity') AS r, c, title FROM clean
  QUALIFY row_number() OVER (PARTITION BY entity, entity_id, t, r ORDER BY title DESC NULLS LAST, c DESC NULLS LAST) = 1),
own AS (SELECT *, lead(r) OVER (PARTITION BY entity, entity_id, t ORDER BY r) AS gone FROM one),
cuts AS (  -- the times from which something received later bounds the statement anew
  SELECT entity, entity_id, t, r, gone, c, title, r AS begun FROM own
  UNION SELECT o.entity, o.entity_id, o.t, o.r, o.gone, o.c, o.title, l.r
  FROM own o JOIN one l ON l.entity = o.entity AND l.entity_id = o.entity_id AND l.t > o.t AND l.r > o.r AND (o.gone IS NULL OR l.r < o.gone)),
bounds AS (
  SELECT k.entity, k.entity_id, k.t, k.r, k.gone, k.c, k.title, k.begun, min(l.t) AS valid_to
  FROM cuts k LEFT JOIN one l ON l.entity = k.entity AND l.entity_id = k.entity_id AND l.t > k.t AND l.r <= k.begun
  GROUP BY ALL),
runs AS (
  SELECT * FROM bounds
  QUALIFY valid_to IS DISTINCT FROM lag(valid_to) OVER (PARTITION BY entity, entity_id, t, r ORDER BY begun)
    OR row_number() OVER (PARTITION BY entity, entity_id, t, r ORDER BY begun) = 1)
SELECT entity, entity_id, CASE WHEN entity = 'channel' THEN c END AS subscriber_count, CASE WHEN entity = 'video' THEN c END AS view_count,
  title, t AS valid_from, valid_to, begun AS recorded_from,
  coalesce(lead(begun) OVER (PARTITION BY entity, entity_id, t, r ORDER BY begun), gone) AS recorded_to
FROM runs""",
    "p6_found": """
WITH d AS (SELECT snapshot_date AS s, row_number() OVER (ORDER BY snapshot_date) AS i, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt
  FROM (SELECT DISTINCT snapshot_date FROM playlists WHERE snapshot_date IS NOT NULL)),
one AS (
  SELECT playlist_id, snapshot_date, items FROM playlists WHERE playlist_id IS NOT NULL AND snapshot_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY playlist_id, snapshot_date ORDER BY last_updated DESC NULLS LAST, items IS NULL) = 1),
k AS (
  SELECT playlist_id, s, i, nxt, items, lag(i) OVER w AS p, lead(i) OVER w AS n,
    last_value(items IGNORE NULLS) OVER (PARTITION BY playlist_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
  FROM one JOIN d ON one.snapshot_date = d.s WINDOW w AS (PARTITION BY playlist_id ORDER BY i))
SELECT strftime(s, '%Y-%m-%d') AS snapshot_date, playlist_id, 'added' AS change FROM k WHERE i > 1 AND (p IS NULL OR p < i - 1)
UNION ALL SELECT strftime(s, '%Y-%m-%d'), playlist_id, 'changed' FROM k WHERE p = i - 1 AND items <> known
UNION ALL SELECT strftime(nxt, '%Y-%m-%d'), playlist_id, 'removed' FROM k WHERE nxt IS NOT NULL AND (n IS NULL OR n > i + 1)""",
}
