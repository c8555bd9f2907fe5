"""Queries of comment quality and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import text as X
from loomspan.operators import quality as Q
from loomspan.plans import texts
from loomspan.session import batch_clock
from loomspan.sources.tables import table

CLOCK = "2025-03-15 12:00:00"


def _subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """The channels followed: those whose playlists are mirrored."""
    return table(spark, folder, "playlists").select("channel_id").filter(F.col("channel_id").isNotNull()).distinct()


def _now(spark: SparkSession, folder: str, with_text: bool = False) -> DataFrame:
    return Q.current_comments(table(spark, folder, "comments"), with_text=with_text).join(Q.owners(table(spark, folder, "videos")), "video_id", "left")


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return Q.classify(table(spark, folder, "comments"), table(spark, folder, "videos"), table(spark, folder, "channels"), _subscriptions(spark, folder), clock=batch_clock(spark, CLOCK))


def comment_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Class, score and author tier of every comment."""
    return _classified(spark, folder).select("comment_id", "author_tier", "quality_class", "score")


def class_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Comments by class."""
    return _classified(spark, folder).groupBy("quality_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 1).alias("total"))


def signal_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How often each signal counts, and the points it gives."""
    parts = _classified(spark, folder).select(F.explode("breakdown").alias("b"))
    return parts.groupBy(F.col("b.signal").alias("signal")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b.points"), 1).alias("points"))


def comment_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every signal that counts for a comment, with its points."""
    return _classified(spark, folder).select("comment_id", F.explode("breakdown").alias("b")).select("comment_id", "b.signal", "b.points")


def quality_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Comments from the best on: quality first, then anti; ignorable ones aren't listed."""
    order = F.when(F.col("quality_class") == "quality", 0).otherwise(1)
    rows = _classified(spark, folder).filter(F.col("quality_class") != "ignorable")
    return rows.orderBy(order, F.col("score").desc(), "comment_id").select("comment_id", "quality_class", "score")


def caps_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Comments from those with most capitalised words within sentences on."""
    rows = _now(spark, folder, True).select("comment_id", F.round(X.mid_sentence_caps_ratio(F.col("text")), 6).alias("caps"))
    return rows.orderBy(F.col("caps").desc(), "comment_id")


def author_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Comments by their author's tier."""
    rows = Q.author_tier(_now(spark, folder), _subscriptions(spark, folder), table(spark, folder, "channels"))
    return rows.groupBy("author_tier").agg(F.count(F.lit(1)).alias("n"))


def author_points(spark: SparkSession, folder: str) -> DataFrame:
    """The points of each channel's owner."""
    return Q.author_points(Q.current_channels(table(spark, folder, "channels")), batch_clock(spark, CLOCK))


def relevance_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points for the rank among a video's top comments."""
    return Q.relevance(_now(spark, folder)).select("comment_id", F.col("rank").cast("bigint").alias("rank"), F.col("size").cast("bigint").alias("size"), "points")


def creator_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The creator's longest reply to each comment."""
    return Q.creator_replies(_now(spark, folder))


def mentioned_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Comments whose replies answer each other."""
    return Q.mentioned_parents(_now(spark, folder))


def thread_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Threads with missing replies by video."""
    return Q.thread_gaps(_now(spark, folder))


def threads_to_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Good threads whose replies aren't complete."""
    return Q.to_expand(_classified(spark, folder))


def authors_to_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Authors whose channel is worth fetching."""
    return Q.to_fetch(_now(spark, folder), _subscriptions(spark, folder))


def thread_rendering(spark: SparkSession, folder: str) -> DataFrame:
    """Comments as text, ordered by video, by threads as they begin, and within these by answers as they come; place counts within the thread."""
    rows = Q.rendered(_now(spark, folder, True))
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("is_reply", F.col("published_at").asc_nulls_last(), "comment_id")) - 1
    ordered = rows.withColumn("place", place).orderBy("video_id", F.col("thread_at").asc_nulls_last(), "thread_id", "place")
    return ordered.select("video_id", "thread_at", "thread_id", "place", "is_reply", "comment_id", "rendered")


def comment_grep(spark: SparkSession, folder: str) -> DataFrame:
    """Top comments, and answers by the creator and by followed channels, that match a pattern, whatever the case."""
    rows = _now(spark, folder, True).filter(X.grep(F.col("text"), "spindle|handbook"))
    tiers = Q.author_tier(rows, _subscriptions(spark, folder), table(spark, folder, "channels"))
    return tiers.filter(Q.shown(replies=False)).select("comment_id", "video_id")


QUERIES = {f.__name__: f for f in (comment_quality, class_histogram, signal_totals, comment_report, quality_listing, caps_listing, author_tiers, author_points, relevance_points, creator_replies, mentioned_parents, thread_gaps, threads_to_expand, authors_to_fetch, thread_rendering, comment_grep)}

_S = X.SPACE
_NOW = rf"""
one AS (SELECT comment_id, video_id, CASE WHEN regexp_matches(parent_id, '[^{_S}]') THEN parent_id END AS parent_id, author_channel_id, coalesce(text_original, '') AS text, like_count, published_at, updated_at, total_reply_count, replies_complete, ordinal
  FROM comments WHERE comment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY last_seen DESC NULLS LAST) = 1),
own AS (SELECT video_id, channel_id AS creator_id FROM videos WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY last_updated DESC NULLS LAST, channel_id DESC NULLS LAST) = 1),
now AS (SELECT one.*, creator_id FROM one LEFT JOIN own USING (video_id)),
subs AS (SELECT DISTINCT channel_id FROM playlists WHERE channel_id IS NOT NULL),
ch AS (SELECT * FROM channels WHERE channel_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY last_updated DESC NULLS LAST, received_at DESC NULLS LAST) = 1),
tier AS (SELECT now.*, CASE WHEN author_channel_id = creator_id THEN 'creator' WHEN subs.channel_id IS NOT NULL THEN 'subscribed' WHEN ch.channel_id IS NOT NULL THEN 'known' ELSE 'unknown' END AS author_tier
  FROM now LEFT JOIN subs ON subs.channel_id = author_channel_id LEFT JOIN ch ON ch.channel_id = author_channel_id),
rep AS (SELECT parent_id, max(length(text))::BIGINT AS reply_length FROM now WHERE parent_id IS NOT NULL AND author_channel_id = creator_id GROUP BY 1),
men AS (SELECT DISTINCT parent_id FROM now WHERE parent_id IS NOT NULL AND regexp_matches(text, '^[{_S}\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]*@')),
rk AS (SELECT comment_id, row_number() OVER (PARTITION BY video_id ORDER BY ordinal NULLS FIRST, comment_id) - 1 AS rank, count(*) OVER (PARTITION BY video_id) AS size FROM now WHERE parent_id IS NULL AND video_id IS NOT NULL),
rel AS (SELECT comment_id, rank, size, round_even(6.0 * (1 - rank / greatest(1, size // 3)), 1) AS points FROM rk WHERE rank < greatest(1, size // 3) AND round_even(6.0 * (1 - rank / greatest(1, size // 3)), 1) > 0),
pt0 AS (SELECT *, lower(regexp_replace(coalesce(custom_url, ''), '^@+', '')) AS handle, lower(regexp_replace(coalesce(title, ''), '^[{_S}]+|[{_S}]+$', '', 'g')) AS tl,
  coalesce(TRY_CAST(regexp_replace(uploads_count, '^[{_S}]+|[{_S}]+$', '', 'g') AS BIGINT), 0) >= 1 OR coalesce(cardinality(playlists_data), 0) > 0 AS is_active FROM ch),
pt1 AS (SELECT *, regexp_replace(handle, '[^\p{{L}}]', '', 'g') AS letters FROM pt0),
pts AS (SELECT channel_id, greatest(-10, -3 * ((regexp_matches(handle, '[0-9]{{5,}}') OR regexp_matches(handle, '[0-9]{{4}}[a-z]'))::INTEGER + regexp_matches(handle, '[bcdfghjklmnpqrstvwxz]{{5,}}')::INTEGER
    + (length(letters) >= 6 AND len(regexp_extract_all(letters, '[aeiou]')) / length(letters) < 0.2)::INTEGER))::DOUBLE AS handle_botlike,
  CASE WHEN NOT is_active AND handle <> '' AND handle = tl THEN -8.0 ELSE 0.0 END::DOUBLE AS handle_eq_name, 0.0::DOUBLE AS default_avatar,
  CASE WHEN date_diff('microsecond', published_at, TIMESTAMP '{CLOCK}') // 1000000 >= 1825 * 86400 THEN 3.0 ELSE 0.0 END::DOUBLE AS age_5y,
  CASE WHEN TRY_CAST(CASE WHEN regexp_matches(regexp_replace(subscriber_count, '^[{_S}]+|[{_S}]+$', '', 'g'), '^[0-9]+$') THEN regexp_replace(subscriber_count, '^[{_S}]+|[{_S}]+$', '', 'g') END AS BIGINT) >= 20 THEN 3.0 ELSE 0.0 END::DOUBLE AS subs_20,
  CASE WHEN is_active THEN 2.0 ELSE 0.0 END::DOUBLE AS active FROM pt1)"""
_T = texts
_CLASSIFIED = rf"""{_NOW},
m AS (SELECT tier.*, {_T._COUNT} AS sents, {_T._MID} AS mid, {_T._ANTI} AS is_anti, len({_T._TECH_WORDS}) AS nw, coalesce(list_sum(list_transform({_T._TECH_WORDS}, lambda w: length(w))), 0) AS letters,
    len(regexp_extract_all(text, '(?i)\b(?:{"|".join(X.DISCOURSE)})\b')) AS marks, len(regexp_extract_all(text, '[{X.SPECIAL_SIGNS}]')) AS signs, regexp_matches(lower(text), '{"|".join(X.CITATIONS)}') AS cites FROM tier),
s AS (SELECT m.*, length(text) >= 200 AND sents >= 1 AND nw > 0 AS ok, coalesce(reply_length, 0) AS rl, men.parent_id IS NOT NULL AS mentioned, coalesce(points, 0) AS relp,
    coalesce(handle_botlike, 0) + coalesce(handle_eq_name, 0) + coalesce(age_5y, 0) + coalesce(subs_20, 0) + coalesce(active, 0) AS author
  FROM m LEFT JOIN rep ON rep.parent_id = m.comment_id LEFT JOIN men ON men.parent_id = m.comment_id LEFT JOIN rel ON rel.comment_id = m.comment_id LEFT JOIN pts ON pts.channel_id = m.author_channel_id),
q AS (SELECT *, CASE WHEN is_anti THEN 0.0 ELSE round((author_tier = 'subscribed')::INTEGER * 100 + cites::INTEGER * 5 + {_T._EFFORT_SQL} + (CASE WHEN sents >= 2 THEN least(5.0, 0.5 * sents) ELSE 0.0 END)
    + (CASE WHEN ok THEN {_T._QUAD("(letters / nw)", "word_length")} + {_T._QUAD("(nw / sents)", "sentence_length")} + {_T._QUAD("marks", "discourse_markers")} + {_T._QUAD("(signs / length(text))", "special_signs")} ELSE 0.0 END)
    + (CASE WHEN floor(mid * 100) >= 2 THEN least(5, floor(mid * 100) - 1) ELSE 0 END) + 2 * coalesce(total_reply_count >= 1, false)::INTEGER + 2 * mentioned::INTEGER + coalesce(like_count > 0, false)::INTEGER
    + coalesce(published_at <> updated_at, false)::INTEGER + (rl > 0)::INTEGER + (rl > 200)::INTEGER + (rl > 400)::INTEGER + (rl > 600)::INTEGER + relp + author, 1) END::DOUBLE AS score,
  author_tier IN ('creator', 'subscribed') OR length(text) >= 200 OR length(text) >= 30 AND regexp_matches(text, '{X.ENTITY}') OR cites AS gate FROM s),
c AS (SELECT *, CASE WHEN is_anti THEN 'anti' WHEN gate AND score >= 5 THEN 'quality' ELSE 'ignorable' END AS quality_class FROM q)"""

_POINTS = {
    "subscribed": "(author_tier = 'subscribed')::INTEGER * 100", "citation": "cites::INTEGER * 5", "effort": _T._EFFORT_SQL, "sentences": "CASE WHEN sents >= 2 THEN least(5.0, 0.5 * sents) ELSE 0.0 END",
    **{k: f"CASE WHEN ok THEN {_T._QUAD(v, k)} ELSE 0.0 END" for k, v in (("word_length", "(letters / nw)"), ("sentence_length", "(nw / sents)"), ("discourse_markers", "marks"), ("special_signs", "(signs / length(text))"))},
    "mid_caps": "CASE WHEN floor(mid * 100) >= 2 THEN least(5, floor(mid * 100) - 1) ELSE 0 END", "replies": "2 * coalesce(total_reply_count >= 1, false)::INTEGER", "reply_chain": "2 * mentioned::INTEGER",
    "likes": "coalesce(like_count > 0, false)::INTEGER", "edited": "coalesce(published_at <> updated_at, false)::INTEGER", "creator_replied": "(rl > 0)::INTEGER",
    **{f"creator_reply_{n}": f"(rl > {n})::INTEGER" for n in (200, 400, 600)}, "relevance": "relp", **{f"author_{k}": f"coalesce(pts.{k}, 0)" for k in ("handle_botlike", "handle_eq_name", "default_avatar", "age_5y", "subs_20", "active")},
}
_SIGNALS = f"""WITH {_CLASSIFIED}, u AS (SELECT comment_id, unnest([{", ".join(f"{{'signal': '{k}', 'points': ({v})::DOUBLE}}" for k, v in _POINTS.items())}]) AS b FROM s LEFT JOIN pts ON pts.channel_id = s.author_channel_id WHERE NOT is_anti),
r AS (SELECT comment_id, b.signal AS signal, b.points AS points FROM u WHERE b.points <> 0) """
ORACLE = {
    "comment_quality": f"WITH {_CLASSIFIED} SELECT comment_id, author_tier, quality_class, score FROM c",
    "class_histogram": f"WITH {_CLASSIFIED} SELECT quality_class, count(*) AS n, round(sum(score), 1) AS total FROM c GROUP BY 1",
    "comment_report": _SIGNALS + "SELECT comment_id, signal, points FROM r",
    "signal_totals": _SIGNALS + "SELECT signal, count(*) AS n, round(sum(points), 1) AS points FROM r GROUP BY 1",
    "quality_listing": f"WITH {_CLASSIFIED} SELECT comment_id, quality_class, score FROM c WHERE quality_class <> 'ignorable' ORDER BY quality_class <> 'quality', score DESC, comment_id",
    "caps_listing": f"WITH {_NOW} SELECT comment_id, round({_T._MID}, 6) AS caps FROM now ORDER BY caps DESC, comment_id",
    "author_tiers": f"WITH {_NOW} SELECT author_tier, count(*) AS n FROM tier GROUP BY 1",
    "author_points": f"WITH {_NOW} SELECT * FROM pts",
    "relevance_points": f"WITH {_NOW} SELECT comment_id, rank::BIGINT AS rank, size::BIGINT AS size, points::DOUBLE AS points FROM rel",
    "creator_replies": f"WITH {_NOW} SELECT * FROM rep",
    "mentioned_parents": f"WITH {_NOW} SELECT * FROM men",
    "thread_gaps": f"""WITH {_NOW}, p AS (SELECT parent_id, count(*) AS present FROM now WHERE parent_id IS NOT NULL GROUP BY 1),
  t AS (SELECT now.video_id, total_reply_count AS t, coalesce(present, 0) AS p FROM now LEFT JOIN p ON p.parent_id = comment_id WHERE now.parent_id IS NULL AND coalesce(total_reply_count, 0) > 0)
  SELECT video_id, count(*) AS threads, count(*) FILTER (t > p) AS threads_with_gaps, coalesce(sum(t) FILTER (t > p), 0)::BIGINT AS replies_reported, coalesce(sum(t - p) FILTER (t > p), 0)::BIGINT AS replies_missing FROM t GROUP BY 1""",
    "threads_to_expand": f"""WITH {_CLASSIFIED}, p AS (SELECT parent_id, count(*) AS present FROM c WHERE parent_id IS NOT NULL GROUP BY 1)
  SELECT comment_id, video_id, score FROM c LEFT JOIN p ON p.parent_id = comment_id WHERE c.parent_id IS NULL AND score >= 10 AND NOT coalesce(replies_complete, false) AND coalesce(total_reply_count, 0) > coalesce(present, 0)""",
    "authors_to_fetch": f"WITH {_NOW} SELECT DISTINCT author_channel_id FROM now ANTI JOIN subs ON subs.channel_id = author_channel_id WHERE length(text) >= 50 AND author_channel_id IS NOT NULL AND author_channel_id IS DISTINCT FROM creator_id",
    "thread_rendering": f"""WITH {_NOW}, p AS (SELECT parent_id, count(*) AS present FROM now WHERE parent_id IS NOT NULL GROUP BY 1), tops AS (SELECT comment_id AS t_id, published_at AS thread_at FROM now WHERE parent_id IS NULL)
  SELECT video_id, thread_at, coalesce(now.parent_id, comment_id) AS thread_id,
    (row_number() OVER (PARTITION BY coalesce(now.parent_id, comment_id) ORDER BY now.parent_id IS NOT NULL, published_at NULLS LAST, comment_id) - 1)::INTEGER AS place, now.parent_id IS NOT NULL AS is_reply, comment_id,
    CASE WHEN now.parent_id IS NULL THEN '' ELSE '  ' END || '[' || comment_id || '] likes: ' || coalesce(like_count, 0)
    || CASE WHEN now.parent_id IS NULL AND coalesce(total_reply_count, 0) > 0 THEN ' | replies: ' || coalesce(present, 0) || '/' || total_reply_count ELSE '' END
    || CASE WHEN now.parent_id IS NULL THEN chr(10) || text ELSE replace(chr(10) || text, chr(10), chr(10) || '  ') END AS rendered
  FROM now LEFT JOIN p ON p.parent_id = comment_id JOIN tops ON t_id = coalesce(now.parent_id, comment_id)""",
    "comment_grep": f"WITH {_NOW} SELECT comment_id, video_id FROM tier WHERE regexp_matches(text, '(?i)spindle|handbook') AND (parent_id IS NULL OR author_tier IN ('creator', 'subscribed'))",
}
