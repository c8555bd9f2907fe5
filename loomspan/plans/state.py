"""Queries of state between runs, of authors in context, of reports, and of the pipeline of models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import images as I
from loomspan.functions import providers as M
from loomspan.functions import text as X
from loomspan.functions import values as V
from loomspan.operators import blocks as B
from loomspan.operators import quality as Q
from loomspan.operators import state as S
from loomspan.operators.media import significant_colors
from loomspan.plans.comments import _CLASSIFIED, _NOW, CLOCK, _classified, _now, _subscriptions
from loomspan.plans.descriptions import _BLOCKS, INDEXED_UNTIL
from loomspan.plans.listings import unavailable_cache
from loomspan.plans.mirror import _V, PAGE, _playlists, _videos
from loomspan.session import batch_clock, shared_folder
from loomspan.sources.tables import table
from loomspan.streaming import flows as W


def _of_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "transcripts").filter("video_id IS NOT NULL").groupBy("video_id").agg(
        F.countDistinct("chunk_id").alias("chunks"), F.max("segment_count").alias("segments"), F.max("fetched_at").alias("fetched_at"), F.max("is_generated").alias("generated")
    )


def stamped_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of transcripts, stamped by a later run of headings."""
    t = _of_transcripts(spark, folder)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    first = t.filter("chunks > 1").select("video_id", F.create_map(F.lit("chunks"), text("chunks"), F.lit("run"), F.lit("1")).alias("meta"))
    later = t.filter("segments % 2 = 0").select("video_id", F.create_map(F.lit("run"), F.lit("2"), F.lit("segments"), text("segments")).alias("meta"))
    entries = F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return S.stamped(first, later, "video_id").select("video_id", F.array_join(entries, ",").alias("meta"))


def _layouts(spark: SparkSession, folder: str) -> DataFrame:
    t = _of_transcripts(spark, folder)
    rows = _videos(spark, folder).select("video_id").join(t, "video_id", "left")
    chunks = F.coalesce("chunks", F.lit(0))
    return rows.select("video_id", S.layout(chunks == 1, chunks > 1, F.coalesce("generated", F.lit(False))).alias("l")).select("video_id", "l.state", "l.action")


def layout_migration(spark: SparkSession, folder: str) -> DataFrame:
    """The state in which each video's transcript is stored, and what a migration does with it."""
    return _layouts(spark, folder)


def migration_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How many transcripts a migration moves, stamps, leaves and skips."""
    return _layouts(spark, folder).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def transcript_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each video: its transcript's size, or why there is none."""
    t = _of_transcripts(spark, folder).select("video_id", "chunks", "segments")
    rows = _videos(spark, folder).select("video_id").join(t, "video_id", "left").join(unavailable_cache(spark, folder), "video_id", "left")
    return rows.select("video_id", F.when(F.col("chunks").isNotNull(), "ok").otherwise(F.concat(F.lit("unavailable:"), "reason")).alias("status"), "chunks", "segments")


def uncleaned_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that a cache of cleaned ones doesn't hold for their present text and prompt."""
    rows = table(spark, folder, "transcripts").filter("transcript_chunk IS NOT NULL AND video_id IS NOT NULL").select("video_id", "chunk_id", "transcript_chunk").distinct()
    cache = rows.filter("chunk_id % 3 <> 0").select("video_id", "chunk_id", F.sha2("transcript_chunk", 256).alias("digest"), F.when(F.col("chunk_id") % 3 == 1, 1).otherwise(2).alias("version"))
    return S.uncached(rows, cache, ["video_id", "chunk_id"], "transcript_chunk", 2).select("video_id", "chunk_id").distinct()


def refreshed_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of blocks, built earlier from older fetches, brought up to date without building it anew."""
    columns = ["channel_id", "checksum", "video_id", "last_updated"]
    rows = table(spark, folder, "videos").filter("video_id IS NOT NULL").select("video_id", "channel_id", "description", "last_updated")
    built = lambda v: B.index(B.blocks(v)).join(v.select("video_id", "last_updated").distinct(), "video_id").select(*columns)
    older = rows.filter(F.col("last_updated") < F.lit(INDEXED_UNTIL).cast("timestamp_ntz"))
    one = older.groupBy("video_id").agg(F.max(F.struct("last_updated", "channel_id", "description")).alias("r")).select("video_id", "r.*")
    return S.rebuilt_index(built(one), built(_videos(spark, folder).select("video_id", "channel_id", "description", "last_updated")), built_with=B.VERSION, version=B.VERSION)


def resumed_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds fetched in two runs: the third page fails in the first, the second goes on from there."""
    lists = _playlists(spark, folder).filter("size(items) > 0").select(F.col("playlist_id").alias("feed"), F.explode(F.sequence(F.lit(0), F.ceil(F.size("items") / PAGE).cast("int") - 1)).alias("page"))
    none = lists.select("feed", F.lit(None).cast("int").alias("token")).limit(0)
    first, state = S.resumed(lists.withColumn("ok", F.col("page") != 2), none)
    second, end = S.resumed(lists.withColumn("ok", F.lit(True)), state.filter("token IS NOT NULL"))
    done = state.filter("complete").select("feed")
    n = lambda df, name: df.groupBy("feed").agg(F.count(F.lit(1)).alias(name))
    rows = state.select("feed", "token").join(n(first, "first_run"), "feed", "left").join(n(second.join(done, "feed", "left_anti"), "second_run"), "feed", "left").join(end.select("feed", "complete"), "feed")
    return rows.fillna(0, ["first_run", "second_run"])


def resumed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a stream that was stopped and went on from its checkpoint when more files had come: each counted once."""
    at = f"{shared_folder(spark)}/resumed-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select("event_id", "event_type")
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{at}/events.parquet")
        rows = W.drained(W.file_stream(spark, at, "events"), at=f"{at}/run")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("different"))


def stopped_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each batch by outcome: a block ends its batch, an error doesn't."""
    outcome = F.when((F.col("event_type") == "signup") & (F.col("value") > 20), "blocked").when(F.col("event_type") == "error", "error").otherwise("ok")
    rows = table(spark, folder, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("place"), outcome.alias("outcome"))
    tried = S.stopped_at_block(rows, "batch", "place", "outcome")
    return tried.groupBy("batch", F.when(F.col("tried"), F.col("outcome")).otherwise("not tried").alias("result")).agg(F.count(F.lit(1)).alias("n"))


def expanded_threads(spark: SparkSession, folder: str) -> DataFrame:
    """Threads after a fetch of their missing replies."""
    now = _now(spark, folder)
    tops = now.filter("parent_id IS NULL").select(F.col("comment_id").alias("thread_id"), F.col("replies_complete").alias("complete"), "total_reply_count")
    there = now.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("thread_id"), "comment_id")
    asked = tops.filter("NOT coalesce(complete, false) AND coalesce(total_reply_count, 0) > 0").select("thread_id")
    fetched = asked.withColumn("comment_id", F.concat("thread_id", F.lit(".new"))).unionByName(there.join(asked, "thread_id", "left_semi"))  # what is here comes again
    return S.expanded(tops.drop("total_reply_count"), there, fetched)


def rescored_threads(spark: SparkSession, folder: str) -> DataFrame:
    """The second pass over threads worth expanding: they and their replies are scored again, nothing else."""
    chosen = Q.to_expand(_classified(spark, folder)).select(F.col("comment_id").alias("thread_id"))
    now = _now(spark, folder).withColumn("thread_id", F.coalesce("parent_id", "comment_id"))
    only = now.join(chosen, "thread_id", "left_semi").select("comment_id")
    rows = Q.classify(table(spark, folder, "comments"), table(spark, folder, "videos"), table(spark, folder, "channels"), _subscriptions(spark, folder), clock=batch_clock(spark, CLOCK), only=only)
    return rows.select("comment_id", "quality_class", "score")


def author_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A line about the author of each comment, by tier."""
    rows = Q.author_tier(_now(spark, folder), _subscriptions(spark, folder), table(spark, folder, "channels")).select("comment_id", "author_channel_id", "author_tier")
    c = Q.current_channels(table(spark, folder, "channels"))
    title = X.strip(F.coalesce("title", F.lit("?")))
    facts = c.select(F.col("channel_id").alias("a_id"), title.alias("title"), F.coalesce(V.to_int(F.col("subscriber_count")).cast("string"), F.lit("?")).alias("subscribers"), F.coalesce(F.size("playlists_data"), F.lit(0)).alias("playlists"))
    tier = F.col("author_tier")
    line = (
        F.when(tier == "creator", "creator").when(tier == "subscribed", F.concat(F.lit("subscribed: "), F.coalesce("title", F.lit("?"))))
        .when(tier == "known", F.concat_ws(" | ", "title", F.concat("subscribers", F.lit(" subscribers")), F.concat(F.col("playlists").cast("string"), F.lit(" playlists")))).otherwise("unknown")
    )
    return rows.join(facts, rows["author_channel_id"] == facts["a_id"], "left").select("comment_id", "author_tier", line.alias("line"))


def author_context(spark: SparkSession, folder: str) -> DataFrame:
    """Each comment with its author's channel, the address of its thumbnail, and how many playlists it has."""
    c = Q.current_channels(table(spark, folder, "channels")).select(
        F.col("channel_id").alias("a_id"), "title", F.col("thumbnails")["default"]["url"].alias("thumbnail"), F.size(F.map_filter("playlists_data", lambda _, v: v != "")).alias("playlists")
    )
    now = _now(spark, folder).select("comment_id", "author_channel_id")
    return now.join(c, now["author_channel_id"] == c["a_id"], "left").select("comment_id", "title", "thumbnail", "playlists")


def _avatars(spark: SparkSession, folder: str) -> DataFrame:
    """Channels with the colours of their avatar, drawn here as stripes, as no images are at hand; every ninth can't be read."""
    c = Q.current_channels(table(spark, folder, "channels"))
    drawn = [I.striped_png(k) for k in range(1, 6)]
    n = F.coalesce(F.length("title"), F.lit(0))
    image = F.when(n % 9 != 0, F.element_at(F.array(*(F.lit(bytearray(d)) for d in drawn)), (n % 5 + 1).cast("int"))).otherwise(F.lit(bytearray(b"broken")))
    return c.withColumn("counts", I.colors_of(image)).withColumn("distinct_colors", significant_colors(F.col("counts")))


def avatar_colors(spark: SparkSession, folder: str) -> DataFrame:
    """How many colours of each avatar's palette cover more than a twentieth of it."""
    return _avatars(spark, folder).select("channel_id", "distinct_colors")


def avatar_points(spark: SparkSession, folder: str) -> DataFrame:
    """The points of each channel's owner, with the mark of a default avatar: two colours at most, and nothing uploaded."""
    rows = _avatars(spark, folder)
    idle = F.length("title") % 2 == 0  # the table's channels are all active: half are taken for idle ones
    rows = rows.withColumn("uploads_count", F.when(idle, "0").otherwise(F.col("uploads_count"))).withColumn("playlists_data", F.when(~F.coalesce(idle, F.lit(False)), F.col("playlists_data")))
    return Q.author_points(rows, batch_clock(spark, CLOCK)).select("channel_id", "default_avatar", "active")


def segment_seconds(spark: SparkSession, folder: str) -> DataFrame:
    """Times rounded to whole seconds, halves to the even one."""
    return table(spark, folder, "events").select("event_id", F.bround("value").cast("bigint").alias("second"))


def error_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Failures by kind, with the status they lead to."""
    kinds = [*V.STATUSES, "Timeout", None]
    kind = F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.pmod("event_id", F.lit(len(kinds))) + 1).cast("int"))
    rows = table(spark, folder, "events").select(kind.alias("kind"))
    return rows.groupBy("kind", V.status_of(F.col("kind")).alias("status"), V.error_label(F.col("kind")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def usage_report(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, seconds and tokens by component and label, the slowest first."""
    rows = table(spark, folder, "events").select("event_type", F.when(F.col("value") > 10, "slow").otherwise("fast").alias("label"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    sums = rows.groupBy(F.col("event_type").alias("component"), "label").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("seconds"), F.sum("tokens").alias("tokens"))
    return sums.orderBy(F.col("seconds").desc(), "component", "label")


def timing_report(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds by component, the labels as columns."""
    return usage_report(spark, folder).groupBy("component").pivot("label", ["fast", "slow"]).agg(F.first("seconds"))


def extraction_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Videos through the pipeline of questions: an extraction, a trace of its sources where that is asked for, and an evaluation."""
    v = _videos(spark, folder).select("video_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"))
    out = M.extracted(v, "video_id", "title", "description", profile="analyst")
    return out.select("video_id", F.array_join("extraction.formats", ",").alias("formats"), F.size("extraction.sources").alias("sources"), "traced", F.col("trace").isNotNull().alias("has_trace"), "evaluation.coverage", "evaluation.verdict")


QUERIES = {f.__name__: f for f in (
    stamped_meta, layout_migration, migration_outcomes, transcript_rows, uncleaned_chunks, refreshed_index, resumed_feeds, resumed_stream, stopped_batches, expanded_threads, rescored_threads, author_lines, author_context, avatar_colors, avatar_points,
    segment_seconds, error_statuses, usage_report, timing_report, extraction_pipeline,
)}

_TR = "t AS (SELECT video_id, count(DISTINCT chunk_id) AS chunks, max(segment_count) AS segments, bool_or(is_generated) AS generated FROM transcripts WHERE video_id IS NOT NULL GROUP BY 1)"
_LAYOUT = f"WITH {_V}, {_TR}, l AS (SELECT video_id, CASE WHEN coalesce(chunks, 0) > 1 AND coalesce(generated, false) THEN 'current' WHEN chunks > 1 THEN 'unstamped' WHEN chunks = 1 THEN 'flat' ELSE 'absent' END AS state FROM v LEFT JOIN t USING (video_id)), a AS (SELECT *, CASE state WHEN 'current' THEN 'none' WHEN 'unstamped' THEN 'stamp' WHEN 'flat' THEN 'move' ELSE 'skip' END AS action FROM l) "
_USAGE = "SELECT event_type AS component, CASE WHEN value > 10 THEN 'slow' ELSE 'fast' END AS label, count(*) AS calls, round(sum(value), 2) AS seconds, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY ALL"
_PL = "p AS (SELECT * FROM playlists WHERE playlist_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY snapshot_date DESC NULLS LAST, last_updated DESC NULLS LAST, items IS NULL, etag DESC NULLS LAST) = 1)"
_KINDS = [*V.STATUSES, "Timeout"]
ORACLE = {
    "stamped_meta": f"""WITH {_TR}, m AS (SELECT video_id, chunks > 1 AS a, coalesce(segments % 2 = 0, false) AS b, chunks, segments FROM t)
SELECT video_id, concat_ws(',', CASE WHEN a THEN 'chunks=' || chunks END, CASE WHEN b THEN 'run=2' ELSE 'run=1' END, CASE WHEN b THEN 'segments=' || coalesce(segments::VARCHAR, 'none') END) AS meta FROM m WHERE a OR b""",
    "layout_migration": _LAYOUT + "SELECT * FROM a",
    "migration_outcomes": _LAYOUT + "SELECT action, count(*) AS n FROM a GROUP BY 1",
    "transcript_rows": f"""WITH {_V}, {_TR}, u AS (SELECT video_id, CASE WHEN privacy_status <> 'public' THEN 'private' WHEN live_status <> 'none' THEN 'live' ELSE 'disabled' END AS reason FROM v ANTI JOIN transcripts USING (video_id))
SELECT video_id, CASE WHEN chunks IS NOT NULL THEN 'ok' ELSE 'unavailable:' || reason END AS status, chunks, segments FROM v LEFT JOIN t USING (video_id) LEFT JOIN u USING (video_id)""",
    "uncleaned_chunks": "SELECT DISTINCT video_id, chunk_id FROM transcripts WHERE transcript_chunk IS NOT NULL AND video_id IS NOT NULL AND chunk_id % 3 <> 2",
    "refreshed_index": f"WITH {_BLOCKS} SELECT DISTINCT bl.channel_id, checksum, video_id, last_updated FROM bl JOIN v USING (video_id) WHERE bl.channel_id IS NOT NULL",
    "resumed_feeds": f"""WITH {_PL}, n AS (SELECT playlist_id AS feed, CAST(ceil(len(items) / {PAGE}.0) AS BIGINT) AS pages FROM p WHERE len(items) > 0)
SELECT feed, CASE WHEN pages > 2 THEN 2 END AS token, least(pages, 2) AS first_run, greatest(pages - 2, 0) AS second_run, true AS complete FROM n""",
    "resumed_stream": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS different FROM events GROUP BY 1",
    "stopped_batches": """WITH r AS (SELECT user_id AS batch, event_id AS place, CASE WHEN event_type = 'signup' AND value > 20 THEN 'blocked' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome FROM events),
m AS (SELECT *, min(CASE WHEN outcome = 'blocked' THEN place END) OVER (PARTITION BY batch) AS e FROM r)
SELECT batch, CASE WHEN e IS NULL OR place <= e THEN outcome ELSE 'not tried' END AS result, count(*) AS n FROM m GROUP BY ALL""",
    "expanded_threads": f"""WITH {_NOW}, r AS (SELECT parent_id, count(*) AS n FROM now WHERE parent_id IS NOT NULL GROUP BY 1), x AS (SELECT comment_id, coalesce(n, 0) AS n, coalesce(replies_complete, false) AS c, NOT coalesce(replies_complete, false) AND coalesce(total_reply_count, 0) > 0 AS e
  FROM now LEFT JOIN r ON r.parent_id = comment_id WHERE now.parent_id IS NULL) SELECT comment_id AS thread_id, n + e::INTEGER AS present, c OR e AS complete FROM x""",
    "rescored_threads": f"""WITH {_CLASSIFIED}, h AS (SELECT parent_id, count(*) AS present FROM c WHERE parent_id IS NOT NULL GROUP BY 1),
  e AS (SELECT comment_id FROM c LEFT JOIN h ON h.parent_id = comment_id WHERE c.parent_id IS NULL AND score >= 10 AND NOT coalesce(replies_complete, false) AND coalesce(total_reply_count, 0) > coalesce(present, 0))
  SELECT comment_id, quality_class, score FROM c WHERE coalesce(parent_id, comment_id) IN (SELECT comment_id FROM e)""",
    "author_lines": rf"""WITH {_NOW}, f AS (SELECT channel_id, regexp_replace(coalesce(title, '?'), '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g') AS t, coalesce(cardinality(playlists_data), 0) AS k,
  coalesce(TRY_CAST(CASE WHEN regexp_matches(regexp_replace(subscriber_count, '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g'), '^[+-]?[0-9]+$') THEN regexp_replace(subscriber_count, '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g') END AS BIGINT)::VARCHAR, '?') AS s FROM ch)
  SELECT comment_id, author_tier, CASE author_tier WHEN 'creator' THEN 'creator' WHEN 'subscribed' THEN 'subscribed: ' || coalesce(t, '?') WHEN 'known' THEN t || ' | ' || s || ' subscribers | ' || k || ' playlists' ELSE 'unknown' END AS line FROM tier LEFT JOIN f ON f.channel_id = author_channel_id""",
    "author_context": f"WITH {_NOW} SELECT comment_id, title, thumbnails['default'].url AS thumbnail, len(list_filter(map_values(playlists_data), lambda x: x <> '')) AS playlists FROM now LEFT JOIN ch ON ch.channel_id = author_channel_id",
    "avatar_colors": f"WITH {_NOW} SELECT channel_id, CASE WHEN coalesce(length(title), 0) % 9 <> 0 THEN least(coalesce(length(title), 0) % 5 + 1, 4) END::INTEGER AS distinct_colors FROM ch",
    "avatar_points": rf"""WITH {_NOW}, a AS (SELECT channel_id, coalesce(length(title) % 2 = 0, false) AS idle, coalesce(length(title), 0) AS n, coalesce(TRY_CAST(regexp_replace(uploads_count, '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g') AS BIGINT), 0) >= 1 OR coalesce(cardinality(playlists_data), 0) > 0 AS was FROM ch)
  SELECT channel_id, CASE WHEN NOT (was AND NOT idle) AND n % 9 <> 0 AND n % 5 + 1 <= 2 THEN -5.0 ELSE 0.0 END::DOUBLE AS default_avatar, CASE WHEN was AND NOT idle THEN 2.0 ELSE 0.0 END::DOUBLE AS active FROM a""",
    "segment_seconds": "SELECT event_id, round_even(value, 0)::BIGINT AS second FROM events",
    "error_statuses": f"""WITH k AS (SELECT {_KINDS!r}[event_id % {len(_KINDS) + 1} + 1] AS kind FROM events) SELECT kind, CASE {" ".join(f"WHEN kind = '{k}' THEN '{s}'" for k, s in V.STATUSES.items())} ELSE 'error' END AS status, 'error:' || coalesce(kind, 'unknown') AS label, count(*) AS n FROM k GROUP BY ALL""",
    "usage_report": _USAGE,
    "timing_report": f"SELECT component, max(seconds) FILTER (label = 'fast') AS fast, max(seconds) FILTER (label = 'slow') AS slow FROM ({_USAGE}) GROUP BY 1",
    "extraction_pipeline": rf"""WITH {_V}, a AS (SELECT video_id, CASE WHEN regexp_matches(lower(coalesce(title, '')), 'news|why') THEN 'commentary' ELSE 'tutorial' END AS formats, len(list_distinct(regexp_extract_all(coalesce(description, ''), 'https?://\S+'))) AS sources, length(coalesce(description, '')) AS n FROM v)
  SELECT video_id, formats, sources, formats = 'commentary' AS traced, formats = 'commentary' AS has_trace, CASE WHEN n >= 200 THEN 'full' WHEN n > 0 THEN 'partial' ELSE 'minimal' END AS coverage, CASE WHEN n = 0 THEN 'need_transcript' WHEN n < 40 THEN 'discard' ELSE 'score' END AS verdict FROM a""",
}
