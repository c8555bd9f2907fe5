"""Queries behind listings, reports and state kept between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import text as X
from loomspan.functions import values as V
from loomspan.functions.providers import entities
from loomspan.operators.latest import latest_row
from loomspan.operators.quality import current_channels, current_comments, owners
from loomspan.plans.comments import CLOCK
from loomspan.plans.transcripts import NAMED_SQL as CHAPTERS_NAMED
from loomspan.plans.transcripts import named_chapters
from loomspan.session import batch_clock
from loomspan.sources.tables import table


def _videos(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = table(spark, folder, "videos").filter("video_id IS NOT NULL").select("video_id", "last_updated", *columns)
    return latest_row(rows, ["video_id"], [F.col("last_updated").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in columns)])


def latest_years(spark: SparkSession, folder: str) -> DataFrame:
    """The five latest years of a channel's uploads, and whether there are more."""
    per = _videos(spark, folder, "channel_id", "published_at").filter("channel_id IS NOT NULL AND published_at IS NOT NULL").groupBy("channel_id", F.year("published_at").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("channel_id")
    ranked = per.withColumn("k", F.row_number().over(w.orderBy(F.col("year").desc()))).withColumn("more", F.count(F.lit(1)).over(w) > 5)
    return ranked.filter("k <= 5").select("channel_id", "year", "n", "more")


def limit_then_grep(spark: SparkSession, folder: str) -> DataFrame:
    """Of the fifty newest videos those whose title matches: the limit comes first, so fewer may show."""
    newest = _videos(spark, folder, "title", "published_at").orderBy(F.col("published_at").desc_nulls_last(), "video_id").limit(50)
    return newest.filter(X.grep(F.col("title"), "how|fix")).select("video_id", V.one_line(F.col("title")).alias("title"))


def chapter_indices(spark: SparkSession, folder: str) -> DataFrame:
    """The chapters a comment names by time, each once, in the order in which it names them first."""
    rows = named_chapters(spark, folder).filter("chapter_no IS NOT NULL")
    named = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "chapter_no"))), lambda c: c["chapter_no"].cast("string")))
    return rows.groupBy("comment_id").agg(F.array_join(named, ",").alias("chapters"))


def author_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A line about each author who has a channel here."""
    c = current_channels(table(spark, folder, "channels"))
    days = F.floor(F.expr(f"timestampdiff(SECOND, published_at, TIMESTAMP_NTZ'{batch_clock(spark, CLOCK)}')") / 86400)
    line = F.concat_ws(" | ", X.strip(F.coalesce("title", F.lit("?"))), F.concat(F.coalesce(V.to_int(F.col("subscriber_count")).cast("string"), F.lit("?")), F.lit(" subscribers")), V.age_label(days))
    authors = current_comments(table(spark, folder, "comments"), with_text=False).select("author_channel_id").filter("author_channel_id IS NOT NULL").distinct()
    return authors.join(c, authors["author_channel_id"] == c["channel_id"]).select("channel_id", line.alias("summary"))


def named_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Names in comments by kind."""
    rows = table(spark, folder, "comments").select("comment_id", "text_original")
    return entities(rows, "comment_id", "text_original").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("different"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts put together for a model from what is known of a video."""
    v = _videos(spark, folder, "title", "description", "duration_data")
    seconds = V.duration_seconds(F.col("duration_data"))
    text = F.format_string("Detail: %s\nLength: %s\nTitle: %s\n---\n%s", V.detail_level(seconds), V.clock(seconds), F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return v.select("video_id", text.alias("prompt"))


def unavailable_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Videos without transcript, marked once so that they aren't asked for again."""
    have = table(spark, folder, "transcripts").select("video_id").distinct()
    gone = _videos(spark, folder, "privacy_status", "live_status").join(have, "video_id", "left_anti")
    reason = F.when(F.col("privacy_status") != "public", "private").when(F.col("live_status") != "none", "live").otherwise("disabled")
    return gone.select("video_id", reason.alias("reason"))


def comments_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each video's comments: complete, partial, or disabled (what is here stays)."""
    here = current_comments(table(spark, folder, "comments"), with_text=False).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    v = _videos(spark, folder, "comment_count").join(here, "video_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    told = V.to_int(F.col("comment_count"))
    state = F.when(told.isNull(), "disabled").when(F.col("n") >= told, "complete").otherwise("partial")
    return v.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("videos"), F.sum("n").alias("comments"))


def thread_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a thread can be expanded: not a reply, not complete already."""
    now = current_comments(table(spark, folder, "comments"), with_text=False)
    verdict = F.when(F.col("parent_id").isNotNull(), "reply").when(F.coalesce("replies_complete", F.lit(False)), "complete").when(F.coalesce("total_reply_count", F.lit(0)) == 0, "nothing").otherwise("expand")
    return now.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def ticket_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The outcome of each ticket: the first that was recorded holds."""
    e = table(spark, folder, "events").select((F.col("event_id") % 4000).alias("ticket"), "ts", "event_id", F.when(F.col("event_type") == "error", "error:Remote").when(F.col("event_type") == "click", "ok").alias("outcome"))
    first = F.min(F.when(F.col("outcome").isNotNull(), F.struct("ts", "event_id", "outcome")))["outcome"]
    return e.groupBy("ticket").agg(F.coalesce(first, F.lit("in flight")).alias("outcome"))


def creators_of_playlists(spark: SparkSession, folder: str) -> DataFrame:
    """Videos of playlists by the channel that owns them: how many are the playlist's own."""
    p = table(spark, folder, "playlists").filter("items IS NOT NULL").select("playlist_id", "channel_id", F.explode("items").alias("video_id")).distinct()
    both = p.join(owners(table(spark, folder, "videos")), "video_id", "left")
    return both.groupBy("playlist_id", "channel_id").agg(F.count(F.lit(1)).alias("videos"), F.count_if(F.col("creator_id") == F.col("channel_id")).alias("own"))


QUERIES = {f.__name__: f for f in (latest_years, limit_then_grep, chapter_indices, author_summary, named_entities, prompts, unavailable_cache, comments_state, thread_expansion, ticket_outcomes, creators_of_playlists)}

_S = X.SPACE
_V = "v AS (SELECT * FROM videos WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY last_updated DESC NULLS LAST) = 1)"
_NOW = f"now AS (SELECT *, CASE WHEN regexp_matches(parent_id, '[^{_S}]') THEN parent_id END AS parent FROM comments WHERE comment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY last_seen DESC NULLS LAST) = 1)"
ORACLE = {
    "latest_years": f"""WITH {_V}, p AS (SELECT channel_id, year(published_at)::INTEGER AS year, count(*) AS n FROM v WHERE channel_id IS NOT NULL AND published_at IS NOT NULL GROUP BY ALL)
SELECT channel_id, year, n, count(*) OVER (PARTITION BY channel_id) > 5 AS more FROM p QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY year DESC) <= 5""",
    "limit_then_grep": f"WITH {_V}, n AS (SELECT * FROM v ORDER BY published_at DESC NULLS LAST, video_id LIMIT 50) SELECT video_id, trim(translate(title, chr(9) || chr(10) || chr(13), '   ')) AS title FROM n WHERE regexp_matches(title, '(?i)how|fix')",
    "chapter_indices": f"WITH base AS ({CHAPTERS_NAMED}) SELECT comment_id, string_agg(chapter_no::VARCHAR, ',' ORDER BY place) AS chapters FROM (SELECT comment_id, chapter_no, min(place) AS place FROM base WHERE chapter_no IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "prompts": rf"""WITH {_V}, d AS (SELECT video_id, title, description, coalesce(CASE WHEN regexp_matches(duration_data, '^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$') THEN
    coalesce(TRY_CAST(regexp_extract(duration_data, '(\d+)D', 1) AS BIGINT), 0) * 86400 + coalesce(TRY_CAST(regexp_extract(duration_data, '(\d+)H', 1) AS BIGINT), 0) * 3600
    + coalesce(TRY_CAST(regexp_extract(duration_data, '(\d+)M', 1) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(duration_data, '(\d+)S', 1) AS BIGINT), 0) END, 0)::BIGINT AS s FROM v)
SELECT video_id, 'Detail: ' || CASE WHEN s <= 600 THEN 'short' WHEN s > 3600 THEN 'long' ELSE 'medium' END || chr(10) || 'Length: ' || CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END
  || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || '---' || chr(10) || coalesce(description, '') AS prompt FROM d""",
    "author_summary": f"""WITH ch AS (SELECT * FROM channels WHERE channel_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY last_updated DESC NULLS LAST, received_at DESC NULLS LAST) = 1),
a AS (SELECT DISTINCT author_channel_id AS channel_id FROM (SELECT author_channel_id, comment_id FROM comments WHERE comment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY last_seen DESC NULLS LAST) = 1) WHERE author_channel_id IS NOT NULL),
b AS (SELECT channel_id, regexp_replace(coalesce(title, '?'), '^[{_S}]+|[{_S}]+$', '', 'g') AS t, coalesce(TRY_CAST(CASE WHEN regexp_matches(regexp_replace(subscriber_count, '^[{_S}]+|[{_S}]+$', '', 'g'), '^[+-]?[0-9]+$') THEN regexp_replace(subscriber_count, '^[{_S}]+|[{_S}]+$', '', 'g') END AS BIGINT)::VARCHAR, '?') AS n,
  date_diff('microsecond', published_at, TIMESTAMP '{CLOCK}') // 1000000 // 86400 AS d FROM ch SEMI JOIN a USING (channel_id))
SELECT channel_id, concat_ws(' | ', t, n || ' subscribers', CASE WHEN d < 30 THEN printf('%dd', d) WHEN d < 365 THEN printf('%dmo', d // 30) WHEN d % 365 // 30 > 0 THEN printf('%dy %dmo', d // 365, d % 365 // 30) WHEN d IS NOT NULL THEN printf('%dy', d // 365) END) AS summary FROM b""",
    "unavailable_cache": f"""WITH {_V} SELECT video_id, CASE WHEN privacy_status <> 'public' THEN 'private' WHEN live_status <> 'none' THEN 'live' ELSE 'disabled' END AS reason FROM v ANTI JOIN transcripts USING (video_id)""",
    "comments_state": f"""WITH {_V}, {_NOW}, h AS (SELECT video_id, count(*) AS n FROM now GROUP BY 1),
j AS (SELECT coalesce(h.n, 0) AS n, TRY_CAST(CASE WHEN regexp_matches(regexp_replace(comment_count, '^[{_S}]+|[{_S}]+$', '', 'g'), '^[+-]?[0-9]+$') THEN regexp_replace(comment_count, '^[{_S}]+|[{_S}]+$', '', 'g') END AS BIGINT) AS told FROM v LEFT JOIN h USING (video_id))
SELECT CASE WHEN told IS NULL THEN 'disabled' WHEN n >= told THEN 'complete' ELSE 'partial' END AS state, count(*) AS videos, sum(n)::BIGINT AS comments FROM j GROUP BY 1""",
    "thread_expansion": f"""WITH {_NOW} SELECT CASE WHEN parent IS NOT NULL THEN 'reply' WHEN coalesce(replies_complete, false) THEN 'complete' WHEN coalesce(total_reply_count, 0) = 0 THEN 'nothing' ELSE 'expand' END AS verdict, count(*) AS n FROM now GROUP BY 1""",
    "ticket_outcomes": """SELECT event_id % 4000 AS ticket, coalesce(arg_min(CASE event_type WHEN 'error' THEN 'error:Remote' WHEN 'click' THEN 'ok' END, (ts, event_id)) FILTER (event_type IN ('error', 'click')), 'in flight') AS outcome FROM events GROUP BY 1""",
    "creators_of_playlists": f"""WITH {_V}, p AS (SELECT DISTINCT playlist_id, channel_id, unnest(items) AS video_id FROM playlists)
SELECT p.playlist_id, p.channel_id, count(*) AS videos, count(*) FILTER (v.channel_id = p.channel_id) AS own FROM p LEFT JOIN v USING (video_id) GROUP BY ALL""",
}
