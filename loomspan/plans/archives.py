"""Queries of change capture, archives and incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import changes as C
from loomspan.operators.latest import latest_row
from loomspan.session import batch_clock
from loomspan.sources.tables import table

SINCE = "2024-06-01 00:00:00"
CLOCK = "2025-03-15 12:00:00"


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "video_updates").filter(F.col("video_id").isNotNull() & F.col("last_updated").isNotNull())
    return latest_row(rows.select("video_id", "title", "view_count", "last_updated", "received_at"), ["video_id", "last_updated"], [F.col(c).desc_nulls_last() for c in ("received_at", "title", "view_count")])


def video_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Observations that differ from the one before in more than counters."""
    return C.consecutive(_observed(spark, folder), ["video_id"], ["last_updated"], ["title"]).filter("changed").select("video_id", "last_updated", "title")


#: Columns of a video that change without the video changing.
VOLATILE = ("first_seen", "last_updated", "view_count", "like_count", "comment_count")


def document_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches of a video whose document differs from the fetch before in anything but the volatile columns; the order of lists doesn't matter."""
    rows = table(spark, folder, "videos").filter(F.col("video_id").isNotNull() & F.col("last_updated").isNotNull())
    # The table's fetches of a video are alike: to each comes one of the day before, with the tags in another order, which is no change, and at times another title.
    other = F.when(F.length("title") % 3 == 0, F.concat("title", F.lit("*"))).otherwise(F.col("title"))
    before = rows.withColumn("last_updated", F.col("last_updated") - F.expr("INTERVAL 1 DAY")).withColumn("tags", F.reverse("tags")).withColumn("title", other)
    rows = rows.unionByName(before)
    content = [c for c in rows.columns if c != "video_id" and c not in VOLATILE]
    hashed = rows.select("video_id", "last_updated", C.content_hash(rows, content).alias("h"))
    one = hashed.groupBy("video_id", "last_updated").agg(F.max("h").alias("h"))
    return C.consecutive(one, ["video_id"], ["last_updated"], ["h"]).filter("changed").select("video_id", "last_updated")


def archive_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Replaced titles as numbered versions."""
    return C.versions_archived(_observed(spark, folder), ["video_id"], ["last_updated"], ["title"]).select("video_id", "version", "title", "last_updated")


def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest version of each video; 0 if nothing was archived."""
    last = archive_versions(spark, folder).groupBy("video_id").agg(F.max("version").alias("v"))
    return _observed(spark, folder).select("video_id").distinct().join(last, "video_id", "left").select("video_id", F.coalesce("v", F.lit(0)).alias("version"))


def channel_weekly_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Replaced states of channels, counters included, the first of each week."""
    rows = table(spark, folder, "channels").filter(F.col("channel_id").isNotNull() & F.col("last_updated").isNotNull())
    one = latest_row(rows, ["channel_id", "last_updated"], [F.col(c).desc_nulls_last() for c in ("received_at", "subscriber_count", "view_count", "title")])
    out = C.weekly_archive(one, ["channel_id"], ["last_updated"], ["title", "subscriber_count", "view_count"], "last_updated")
    return out.select("channel_id", "year", "week", "last_updated", "archived_at")


def comment_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches of a comment whose content differs from the fetch before; counts and fetch times don't matter, nor do new comments."""
    rows = table(spark, folder, "comments").filter(F.col("comment_id").isNotNull()).select("comment_id", "text_original", "updated_at", "last_seen").distinct()
    return C.consecutive(rows, ["comment_id"], ["last_seen", "updated_at", "text_original"], ["text_original", "updated_at"]).filter("changed").select("comment_id", "last_seen")


def snapshot_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """An older and a newer mirror of the comments merged: first and last sight kept, nothing lost."""
    rows = table(spark, folder, "comments").filter(F.col("comment_id").isNotNull()).select("comment_id", "like_count", "first_seen", "last_seen")
    one = lambda df: latest_row(df, ["comment_id"], [F.col("last_seen").desc_nulls_last(), F.col("like_count").desc_nulls_last(), F.col("first_seen").desc_nulls_last()])
    cut = F.lit(SINCE).cast("timestamp_ntz")
    return C.upsert(one(rows.filter(F.col("last_seen") < cut)), one(rows.filter(F.col("last_seen") >= cut)), "comment_id", "last_seen", first="first_seen", last="last_seen")


def _last_two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "playlists").filter(F.col("playlist_id").isNotNull() & F.col("snapshot_date").isNotNull())
    dates = rows.select("snapshot_date").distinct().withColumn("n", F.row_number().over(Window.orderBy(F.col("snapshot_date").desc())))  # a row a delivery
    ranked = rows.join(dates.filter("n <= 2"), "snapshot_date")
    one = latest_row(ranked, ["snapshot_date", "playlist_id"], [F.col("last_updated").desc_nulls_last(), F.col("items").isNull(), F.col("etag").desc_nulls_last()])
    return one.filter("n = 2").drop("n"), one.filter("n = 1").drop("n")


def removed_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Playlists that were stored and aren't seen any more, with the time of removal."""
    old, new = _last_two(spark, folder)
    return C.removed(old.select("playlist_id", "channel_id"), new, "playlist_id", batch_clock(spark, CLOCK))


def playlist_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Playlists refreshed from a newer list: unchanged if both tags agree; items are kept if theirs does, or if they weren't fetched."""
    old, new = _last_two(spark, folder)
    o = old.select("playlist_id", F.col("etag").alias("o_etag"), F.col("items_etag").alias("o_items_etag"), F.col("items").alias("o_items"), F.col("first_seen").alias("o_first"))
    same, same_items = F.col("etag").eqNullSafe(F.col("o_etag")), F.col("items_etag").eqNullSafe(F.col("o_items_etag"))
    both = new.join(o, "playlist_id", "left")
    state = F.when(F.col("o_first").isNull(), "new").when(same & same_items, "unchanged").when(same_items, "metadata").otherwise("items")
    items = F.when(same_items, F.coalesce("o_items", "items")).otherwise(F.coalesce("items", "o_items"))
    return both.select("playlist_id", state.alias("state"), F.array_join(items, ",").alias("items"), F.least("first_seen", F.coalesce("o_first", "first_seen")).alias("first_seen"))


def ordered_list_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Item lists of consecutive snapshots merged in order, and whether the older one is archived."""
    old, new = _last_two(spark, folder)
    pairs = old.select("playlist_id", F.col("items").alias("old")).join(new.select("playlist_id", F.col("items").alias("new")), "playlist_id")
    return C.merged_lists(pairs, ["playlist_id"])


def _uploads(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "videos").filter(F.col("channel_id").isNotNull() & F.col("published_at").isNotNull()).select("channel_id", "video_id", "published_at").distinct()


def uploads_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads of channels by year: how many, the newest and the oldest."""
    year = F.year("published_at").alias("year")
    return _uploads(spark, folder).groupBy("channel_id", year).agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("newest"), F.min("published_at").alias("oldest"))


def uploads_refresh_merge(spark: SparkSession, folder: str) -> DataFrame:
    """An index of uploads with its newest page fetched again."""
    rows, cut = _uploads(spark, folder), F.lit(SINCE).cast("timestamp_ntz")
    old = rows.filter(F.col("published_at") < F.expr(f"TIMESTAMP_NTZ'{SINCE}' + INTERVAL 60 DAYS"))
    return C.refreshed_uploads(old, rows.filter(F.col("published_at") >= cut), "channel_id", "published_at")


def incremental_since_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads after the newest one already seen of their channel, and the watermark they leave."""
    rows = _uploads(spark, folder)
    seen = rows.filter(F.col("published_at") < F.lit(SINCE).cast("timestamp_ntz")).groupBy("channel_id").agg(F.max("published_at").alias("mark"))
    fresh = rows.join(seen, "channel_id", "left").filter(F.col("mark").isNull() | (F.col("published_at") > F.col("mark")))
    return fresh.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("watermark"))


def undone_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the rating log that the current list lacks and the active store still has."""
    e = table(spark, folder, "events").select("event_type", "ts", F.pmod(F.col("event_id") * 31, F.lit(7919)).alias("rated_id"))
    log = e.filter("event_type = 'purchase' AND ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'").select("rated_id").distinct()
    now = e.filter("event_type = 'purchase' AND ts >= TIMESTAMP_NTZ'2024-01-20 00:00:00'").select("rated_id").distinct()
    active = e.filter("event_type <> 'purchase'").select("rated_id").distinct()
    return log.join(now, "rated_id", "left_anti").join(active, "rated_id", "left_semi")


def rating_log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The tail of a log behind a time, found past the newest five rows; and a log whose last row is old enough, which is given whole."""
    e = table(spark, folder, "events").select("event_id", "ts")
    tail = C.log_tail(e, ["ts", "event_id"], "ts", "2024-01-30 00:00:00", 5).withColumn("run", F.lit("tail"))
    return tail.unionByName(C.log_tail(e, ["ts", "event_id"], "ts", "2030-01-01 00:00:00").withColumn("run", F.lit("whole")))


def stale_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Videos whose output is missing or was made of an older state or by an older version."""
    now = latest_row(table(spark, folder, "videos").filter(F.col("video_id").isNotNull()).select("video_id", "last_updated"), ["video_id"], [F.col("last_updated").desc_nulls_last()]).withColumn("version", F.lit(10))
    made = table(spark, folder, "videos").select("video_id", "last_updated", F.when(F.ascii(F.substring("video_id", -1, 1)) % 3 == 0, 9).otherwise(10).alias("version")).distinct()
    return now.join(made, ["video_id", "last_updated", "version"], "left_anti").select("video_id")


def work_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The batch of each user until ten events have done work."""
    e = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("did_work"))
    return C.within_budget(e, ["user_id"], ["event_id"], "did_work", 10).groupBy("user_id").agg(F.count(F.lit(1)).alias("processed"), F.count_if("did_work").alias("worked"))


def page_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Comments of a video fetched page by page until 40 are there."""
    rows = table(spark, folder, "comments").filter(F.col("video_id").isNotNull() & F.col("ordinal").isNotNull()).select("video_id", "comment_id", F.floor(F.col("ordinal") / 20).alias("page")).distinct()
    return C.whole_pages(rows, ["video_id"], "page", 40).groupBy("video_id").agg(F.count(F.lit(1)).alias("fetched"), (F.max("page") + 1).cast("bigint").alias("pages"))


def sync_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What a sync of each channel does at the batch clock: nothing within a day, a full mirror if none was made, else the recent uploads."""
    now = latest_row(table(spark, folder, "channels").filter(F.col("channel_id").isNotNull()).select("channel_id", "last_updated", "uploads_count"), ["channel_id"], [F.col(c).desc_nulls_last() for c in ("last_updated", "uploads_count")])
    mirrored = _uploads(spark, folder).select("channel_id").distinct().withColumn("m", F.lit(True))
    fresh = F.col("last_updated") >= F.expr(f"TIMESTAMP_NTZ'{batch_clock(spark, CLOCK)}' - INTERVAL 1 DAY")
    return now.join(mirrored, "channel_id", "left").select("channel_id", F.when(fresh, "fresh").when(F.col("m").isNull(), "full").otherwise("recent").alias("decision"))


def batch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Videos of a transcript batch: processed, missing, or without text."""
    t = table(spark, folder, "transcripts").groupBy("video_id").agg(F.max(F.length("transcript_chunk")).alias("n"))
    v = table(spark, folder, "videos").select("video_id").distinct()
    outcome = F.when(F.col("n").isNull(), "missing").when(F.col("n") == 0, "empty").otherwise("processed")
    return v.join(t, "video_id", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (video_changes, document_changes, archive_versions, latest_versions, channel_weekly_archive, comment_edits, snapshot_upsert, removed_entities, playlist_refresh, ordered_list_merge, uploads_by_year,
                                   uploads_refresh_merge, incremental_since_watermark, undone_ratings, rating_log_tail, stale_outputs, work_budget, page_cap, sync_decisions, batch_outcomes)}

_OBS = """obs AS (SELECT video_id, title, view_count, last_updated FROM video_updates WHERE video_id IS NOT NULL AND last_updated IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY video_id, last_updated ORDER BY received_at DESC NULLS LAST, title DESC NULLS LAST, view_count DESC NULLS LAST) = 1),
ver AS (SELECT video_id, title, last_updated, row_number() OVER (PARTITION BY video_id ORDER BY last_updated)::INTEGER AS version FROM (
  SELECT *, lead(title) OVER w AS nt, lead(video_id) OVER w AS nv FROM obs WINDOW w AS (PARTITION BY video_id ORDER BY last_updated)) WHERE nv IS NOT NULL AND nt IS DISTINCT FROM title)"""
_TWO = """d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date DESC) AS n FROM (SELECT DISTINCT snapshot_date FROM playlists WHERE snapshot_date IS NOT NULL)),
p AS (SELECT playlists.*, n FROM playlists JOIN d USING (snapshot_date) WHERE n <= 2 AND playlist_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_date, playlist_id ORDER BY last_updated DESC NULLS LAST, items IS NULL, etag DESC NULLS LAST) = 1),
o AS (SELECT * FROM p WHERE n = 2), w AS (SELECT * FROM p WHERE n = 1)"""
_UP = "up AS (SELECT DISTINCT channel_id, video_id, published_at FROM videos WHERE channel_id IS NOT NULL AND published_at IS NOT NULL)"
ORACLE = {
    "document_changes": """WITH w AS (SELECT * FROM videos UNION ALL BY NAME SELECT * REPLACE (last_updated - INTERVAL 1 DAY AS last_updated, CASE WHEN length(title) % 3 = 0 THEN title || '*' ELSE title END AS title) FROM videos), d AS (SELECT DISTINCT video_id, last_updated, to_json(v) AS doc FROM (
    SELECT video_id, last_updated, (SELECT x FROM (SELECT w.* EXCLUDE (video_id, last_updated, first_seen, view_count, like_count, comment_count) REPLACE (list_sort(w.tags) AS tags)) x) AS v
    FROM w WHERE video_id IS NOT NULL AND last_updated IS NOT NULL))
  SELECT video_id, last_updated FROM d QUALIFY doc <> lag(doc) OVER (PARTITION BY video_id ORDER BY last_updated)""",
    "video_changes": f"WITH {_OBS} SELECT video_id, last_updated, title FROM (SELECT *, lag(title) OVER w AS t0, lag(video_id) OVER w AS v0 FROM obs WINDOW w AS (PARTITION BY video_id ORDER BY last_updated)) WHERE v0 IS NOT NULL AND t0 IS DISTINCT FROM title",
    "archive_versions": f"WITH {_OBS} SELECT video_id, version, title, last_updated FROM ver",
    "latest_versions": f"WITH {_OBS} SELECT v.video_id, coalesce(max(version), 0)::INTEGER AS version FROM (SELECT DISTINCT video_id FROM obs) v LEFT JOIN ver USING (video_id) GROUP BY 1",
    "channel_weekly_archive": """WITH one AS (SELECT * FROM channels WHERE channel_id IS NOT NULL AND last_updated IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY channel_id, last_updated ORDER BY received_at DESC NULLS LAST, subscriber_count DESC NULLS LAST, view_count DESC NULLS LAST, title DESC NULLS LAST) = 1),
n AS (SELECT channel_id, last_updated, title, subscriber_count, view_count, lead(title) OVER w AS t, lead(subscriber_count) OVER w AS s, lead(view_count) OVER w AS v, lead(last_updated) OVER w AS archived_at FROM one WINDOW w AS (PARTITION BY channel_id ORDER BY last_updated))
SELECT channel_id, year(archived_at)::INTEGER AS year, weekofyear(archived_at)::INTEGER AS week, last_updated, archived_at FROM n
WHERE archived_at IS NOT NULL AND (t IS DISTINCT FROM title OR s IS DISTINCT FROM subscriber_count OR v IS DISTINCT FROM view_count)
QUALIFY row_number() OVER (PARTITION BY channel_id, year(archived_at), weekofyear(archived_at) ORDER BY archived_at) = 1""",
    "comment_edits": """WITH r AS (SELECT DISTINCT comment_id, text_original, updated_at, last_seen FROM comments WHERE comment_id IS NOT NULL),
l AS (SELECT *, lag(text_original) OVER w AS t0, lag(updated_at) OVER w AS u0, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY comment_id ORDER BY last_seen NULLS FIRST, updated_at NULLS FIRST, text_original NULLS FIRST))
SELECT comment_id, last_seen FROM l WHERE n > 1 AND (t0 IS DISTINCT FROM text_original OR u0 IS DISTINCT FROM updated_at)""",
    "snapshot_upsert": f"""WITH o AS (SELECT *, (last_seen >= TIMESTAMP '{SINCE}')::INTEGER AS new FROM comments WHERE comment_id IS NOT NULL AND last_seen IS NOT NULL),
one AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY comment_id, new ORDER BY last_seen DESC NULLS LAST, like_count DESC NULLS LAST, first_seen DESC NULLS LAST) = 1)
SELECT comment_id, like_count, min(first_seen) OVER (PARTITION BY comment_id) AS first_seen, max(last_seen) OVER (PARTITION BY comment_id) AS last_seen FROM one
QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY new DESC, last_seen DESC) = 1""",
    "removed_entities": f"WITH {_TWO} SELECT playlist_id, channel_id, TIMESTAMP '{CLOCK}' AS removed_at FROM o ANTI JOIN w USING (playlist_id)",
    "playlist_refresh": f"""WITH {_TWO} SELECT w.playlist_id, CASE WHEN o.first_seen IS NULL THEN 'new' WHEN w.etag IS NOT DISTINCT FROM o.etag AND w.items_etag IS NOT DISTINCT FROM o.items_etag THEN 'unchanged' WHEN w.items_etag IS NOT DISTINCT FROM o.items_etag THEN 'metadata' ELSE 'items' END AS state,
  array_to_string(CASE WHEN w.items_etag IS NOT DISTINCT FROM o.items_etag THEN coalesce(o.items, w.items) ELSE coalesce(w.items, o.items) END, ',') AS items, least(w.first_seen, coalesce(o.first_seen, w.first_seen)) AS first_seen FROM w LEFT JOIN o USING (playlist_id)""",
    "uploads_by_year": f"WITH {_UP} SELECT channel_id, year(published_at)::INTEGER AS year, count(*) AS n, max(published_at) AS newest, min(published_at) AS oldest FROM up GROUP BY ALL",
    "uploads_refresh_merge": f"""WITH {_UP}, new AS (SELECT * FROM up WHERE published_at >= TIMESTAMP '{SINCE}'), m AS (SELECT channel_id, min(published_at) AS oldest FROM new GROUP BY 1)
SELECT * FROM new UNION ALL SELECT up.* FROM up LEFT JOIN m USING (channel_id) WHERE published_at < TIMESTAMP '{SINCE}' + INTERVAL 60 DAY AND (oldest IS NULL OR published_at < oldest)""",
    "incremental_since_watermark": f"""WITH {_UP}, s AS (SELECT channel_id, max(published_at) AS mark FROM up WHERE published_at < TIMESTAMP '{SINCE}' GROUP BY 1)
SELECT channel_id, count(*) AS n, max(published_at) AS watermark FROM up LEFT JOIN s USING (channel_id) WHERE mark IS NULL OR published_at > mark GROUP BY 1""",
    "undone_ratings": """WITH e AS (SELECT *, event_id * 31 % 7919 AS rated_id FROM events)
  SELECT DISTINCT rated_id FROM e WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-20' AND rated_id NOT IN (SELECT rated_id FROM e WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-20')
  AND rated_id IN (SELECT rated_id FROM e WHERE event_type <> 'purchase')""",
    "rating_log_tail": """WITH n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS i FROM events), s AS (SELECT min(i) AS i FROM n WHERE i > 5 AND ts <= TIMESTAMP '2024-01-30 00:00:00')
  SELECT event_id, ts, 'tail' AS run FROM n WHERE i < (SELECT i FROM s) UNION ALL SELECT event_id, ts, 'whole' FROM events""",
    "stale_outputs": """WITH n AS (SELECT video_id, max(last_updated) AS last_updated FROM videos WHERE video_id IS NOT NULL GROUP BY 1), m AS (SELECT DISTINCT video_id, last_updated FROM videos WHERE ascii(right(video_id, 1)) % 3 <> 0)
SELECT video_id FROM n ANTI JOIN m USING (video_id, last_updated)""",
    "work_budget": """WITH e AS (SELECT user_id, event_id, event_type = 'click' AS did_work, coalesce(sum((event_type = 'click')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM events)
SELECT user_id, count(*) AS processed, count(*) FILTER (did_work) AS worked FROM e WHERE used < 10 GROUP BY 1""",
    "page_cap": """WITH r AS (SELECT DISTINCT video_id, comment_id, ordinal // 20 AS page FROM comments WHERE video_id IS NOT NULL AND ordinal IS NOT NULL), c AS (SELECT video_id, page, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY video_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT video_id, sum(n)::BIGINT AS fetched, (max(page) + 1)::BIGINT AS pages FROM k WHERE before < 40 GROUP BY 1""",
    "sync_decisions": f"""WITH {_UP}, c AS (SELECT channel_id, max(last_updated) AS last_updated FROM channels WHERE channel_id IS NOT NULL GROUP BY 1)
SELECT channel_id, CASE WHEN last_updated >= TIMESTAMP '{CLOCK}' - INTERVAL 1 DAY THEN 'fresh' WHEN channel_id NOT IN (SELECT channel_id FROM up) THEN 'full' ELSE 'recent' END AS decision FROM c""",
    "batch_outcomes": """WITH t AS (SELECT video_id, max(length(transcript_chunk)) AS n FROM transcripts GROUP BY 1), v AS (SELECT DISTINCT video_id FROM videos)
SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'processed' END AS outcome, count(*) AS n FROM v LEFT JOIN t USING (video_id) GROUP BY 1""",
}
