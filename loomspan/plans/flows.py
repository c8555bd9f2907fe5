"""Queries of sources, streams, media and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.providers import asked, conversed
from loomspan.operators import limits as L
from loomspan.operators import media as M
from loomspan.operators.latest import latest_row
from loomspan.plans.requests import admitted_sql
from loomspan.sources import mirror as S
from loomspan.sources.tables import table
from loomspan.streaming import flows as W


#: Limits of the streamed buckets: seconds, most requests.
WINDOWS = ((1, 1), (60, 5), (3600, 25), (86400, 200))
BUCKETS = ("view", "click", "purchase", "signup", "error")


def thread_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Threads nested as an interface gives them, flattened to rows again."""
    rows = table(spark, folder, "comments").filter("comment_id IS NOT NULL AND text_original IS NOT NULL").select("comment_id", "video_id", "text_original", "like_count", "total_reply_count").distinct()
    comment = lambda i: F.struct(i.alias("id"), F.struct(F.lit(None).cast("string").alias("parentId"), F.col("text_original").alias("textOriginal"), F.col("like_count").alias("likeCount"), F.lit(None).cast("string").alias("publishedAt"), F.struct(F.lit("a").alias("value")).alias("authorChannelId")).alias("snippet"))
    nested = F.struct(
        F.col("comment_id").alias("id"), F.struct(F.col("video_id").alias("videoId"), F.col("total_reply_count").alias("totalReplyCount"), comment(F.col("comment_id")).alias("topLevelComment")).alias("snippet"),
        F.struct(F.array(comment(F.concat("comment_id", F.lit("-r")))).alias("comments")).alias("replies"),
    )
    return S.flatten_threads(rows.select(nested.cast(S.THREAD).alias("thread"))).select("video_id", "ordinal", "comment_id", "parent_id", "like_count", "total_reply_count")


def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Videos named by playlists that the mirror doesn't hold."""
    asked_for = table(spark, folder, "playlists").select(F.explode("items").alias("video_id"))
    return S.missing(asked_for, table(spark, folder, "videos"), "video_id")


def stream_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and hour, from a stream; without the hours that the watermark hasn't passed."""
    events = W.file_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.drained(W.usage_by_window(events, "ts")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


def stream_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads from a stream, once each."""
    rows = W.file_stream(spark, folder, "videos").filter("video_id IS NOT NULL AND published_at IS NOT NULL").select("video_id", "channel_id", F.col("published_at").cast("timestamp").alias("published_at"))
    return W.drained(W.fresh_uploads(rows, "published_at", "36500 days")).select("video_id")


def stream_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Requests admitted or refused by a stream with state."""
    rows = L.with_micros(W.file_stream(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("bucket"), F.col("ts").alias("requested_at"), F.lit(1).alias("cost")))
    return W.drained(W.admission(rows, {b: (WINDOWS, None) for b in BUCKETS}))


def media_pointers(spark: SparkSession, folder: str) -> DataFrame:
    """The usable file of each part, of several pointers to it."""
    rows = table(spark, folder, "part").select("p_partkey", "p_size", "p_type", F.explode(F.array(F.lit(0), F.lit(1), F.lit(1), F.lit(2))).alias("n"))
    rows = rows.select("p_partkey", F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("path"), F.col("n").alias("added"), (F.pmod(F.col("p_size") + F.col("n"), F.lit(3)) != 0).alias("exists"), F.when(F.col("n") > 0, F.pmod("p_size", F.lit(2)) == 0).alias("has_video"), F.lit(None).cast("boolean").alias("has_audio"))
    return M.usable_pointer(M.distinct_pointers(rows, "p_partkey"), "p_partkey", video=True, audio=False).select("p_partkey", "path", "to_probe")


def timing_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Sums by user and type, the types as columns."""
    kinds = ["view", "click", "purchase"]
    return table(spark, folder, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.round(F.sum("value"), 2))


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk of a transcript cleaned by a provider."""
    rows = table(spark, folder, "transcripts").select(F.concat_ws("-", "video_id", "chunk_id").alias("id"), F.concat(F.lit("Clean up.\n---\n"), "transcript_chunk").alias("prompt"))
    return asked(rows, "id", "prompt").select("id", F.length("answer").alias("n")).distinct()


def model_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a transcript cleaned in order, each with the answers before it."""
    rows = latest_row(table(spark, folder, "transcripts").select("video_id", "chunk_id", "transcript_chunk"), ["video_id", "chunk_id"], [F.col("transcript_chunk").desc()])
    return conversed(rows, "video_id", "chunk_id", "transcript_chunk").select("video_id", "chunk_id", F.length("answer").alias("n"))


QUERIES = {f.__name__: f for f in (thread_flatten, cache_misses, stream_usage, stream_uploads, stream_admission, media_pointers, timing_pivot, model_answers, model_chunks)}

_CLEANED = r"length(trim(regexp_replace(regexp_replace(transcript_chunk, '\b(?:u+h+|u+m+|er+m*|hm+)\b[,.…]*\s?', '', 'gi'), '\s{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)))::INTEGER"
ORACLE = {
    "model_answers": f"SELECT DISTINCT concat_ws('-', video_id, chunk_id) AS id, {_CLEANED} AS n FROM transcripts",
    "model_chunks": f"WITH one AS (SELECT video_id, chunk_id, max(transcript_chunk) AS transcript_chunk FROM transcripts GROUP BY ALL) SELECT video_id, chunk_id, {_CLEANED} AS n FROM one",
    "stream_admission": admitted_sql({b: WINDOWS for b in BUCKETS}, "1"),
    "thread_flatten": """WITH r AS (SELECT DISTINCT comment_id, video_id, text_original, like_count, total_reply_count FROM comments WHERE comment_id IS NOT NULL AND text_original IS NOT NULL)
SELECT video_id, 0 AS ordinal, comment_id, NULL::VARCHAR AS parent_id, like_count, total_reply_count FROM r UNION ALL SELECT video_id, 1, comment_id || '-r', comment_id, like_count, 0 FROM r""",
    "cache_misses": "SELECT DISTINCT video_id FROM (SELECT unnest(items) AS video_id FROM playlists) ANTI JOIN videos USING (video_id)",
    "stream_usage": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""",
    "stream_uploads": "SELECT DISTINCT video_id FROM videos WHERE video_id IS NOT NULL AND published_at IS NOT NULL",
    "media_pointers": """WITH p AS (SELECT DISTINCT p_partkey, p_size, n FROM part, (SELECT unnest([0, 1, 2]) AS n))
SELECT p_partkey, '/m/' || p_partkey || '-' || n AS path, n = 0 AS to_probe FROM p WHERE (p_size + n) % 3 <> 0 AND (n = 0 OR p_size % 2 = 0) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n) = 1""",
    "timing_pivot": """SELECT user_id, round(sum(value) FILTER (event_type = 'view'), 2) AS view, round(sum(value) FILTER (event_type = 'click'), 2) AS click, round(sum(value) FILTER (event_type = 'purchase'), 2) AS purchase FROM events GROUP BY 1""",
}
