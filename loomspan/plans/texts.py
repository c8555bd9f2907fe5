"""Queries of the scalar functions over text and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import text as X
from loomspan.functions import values as V
from loomspan.operators.latest import latest_row
from loomspan.session import batch_clock
from loomspan.sources.tables import table

# Units of the data interface's quota that a call costs.
CALL_COSTS = {"search.list": 100, "videos.list": 1, "channels.list": 1, "playlists.list": 1, "playlistItems.list": 1, "commentThreads.list": 1, "comments.list": 1, "subscriptions.list": 1, "videos.getRating": 1}

_R = lambda c: F.round(c, 6)


def text_features(spark: SparkSession, folder: str) -> DataFrame:
    """Structural measures of every document."""
    docs = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    f = docs.select("doc_id", X.structural_features(F.col("text")).alias("f"))
    return f.select("doc_id", "f.length", "f.sentence_count", *(_R(F.col(f"f.{c}")).alias(c) for c in ("type_token_ratio", "caps_ratio", "emoji_density", "punctuation_ratio", "mid_sentence_caps_ratio")))


def effort_and_technicality(spark: SparkSession, folder: str) -> DataFrame:
    """Points for length, sentences, capitals and technical writing."""
    docs = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    t = F.col("text")
    f = docs.select("doc_id", X.effort_points(F.length(t)).alias("effort"), X.sentence_bonus(X.sentence_count(t)).alias("sentences"), X.caps_step(X.mid_sentence_caps_ratio(t)).alias("caps"), X.technicality(t).alias("t"))
    return f.select("doc_id", "effort", "sentences", "caps", *(F.col(f"t.{k}").alias(k) for k in X.TECHNICAL))


def text_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Predicates over the lines of all descriptions."""
    lines = table(spark, folder, "videos").select(F.explode(F.split("description", "\n", -1)).alias("line"))
    line = F.col("line")
    return lines.select(
        "line", X.has_link(line).alias("has_link"), X.has_line_time(line).alias("has_time"), X.is_hashtags(line).alias("is_hashtags"), X.is_separator(line).alias("is_separator"),
        X.has_url(line).alias("has_url"), X.has_citation(line).alias("has_citation"), X.display_length(line).alias("display_length"),
    ).groupBy("line", "has_link", "has_time", "is_hashtags", "is_separator", "has_url", "has_citation", "display_length").agg(F.count(F.lit(1)).alias("n"))


def comment_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """Every time named in a comment."""
    rows = table(spark, folder, "comments").select("comment_id", "last_seen", F.posexplode(X.timestamps(F.col("text_original"))).alias("i", "t"))
    return rows.select("comment_id", F.col("i").cast("bigint").alias("i"), F.col("t.seconds").cast("bigint").alias("seconds"), F.col("t.text").alias("text")).distinct()


def anti_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Comments that shout, consist of emoji or of addresses alone."""
    rows = table(spark, folder, "comments").filter(F.col("text_original").isNotNull())
    return rows.groupBy(X.is_anti(F.col("text_original")).alias("anti"), X.has_url(F.col("text_original")).alias("has_url")).agg(F.count(F.lit(1)).alias("n"))


def handle_botlike(spark: SparkSession, folder: str) -> DataFrame:
    """Why handles look generated."""
    handles = table(spark, folder, "channels").select(V.handle_key(F.col("custom_url")).alias("handle")).filter(F.col("handle").isNotNull()).distinct()
    return handles.select("handle", F.array_join(X.botlike_reasons(F.col("handle")), "; ").alias("reasons"))


def typed_channels(spark: SparkSession, folder: str) -> DataFrame:
    """The latest observation of each channel with typed counters."""
    rows = table(spark, folder, "channels")
    cols = ["channel_id", "title", "custom_url", "view_count", "subscriber_count", "uploads_count", "schema_version"]
    one = latest_row(rows.filter(F.col("channel_id").isNotNull()), ["channel_id"], [F.col("last_updated").desc_nulls_last(), F.col("received_at").desc_nulls_last()]).select(*cols)
    schema = T.StructType([T.StructField(c, T.LongType() if c.endswith("count") else T.StringType()) for c in cols[:-1]] + [T.StructField("schema_version", T.IntegerType())])
    return V.coerce(one, schema)


def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Paths into JSON text; a missing path is null."""
    rows = table(spark, folder, "events")
    return rows.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.missing.deeper").alias("deeper"))


def schema_migration(spark: SparkSession, folder: str) -> DataFrame:
    """Channels brought to the present schema version: old rows lose two fields, their counter is renamed."""
    rows = table(spark, folder, "channels").filter(F.col("channel_id").isNotNull())
    # The rows of the table are of the present version: every third is taken for one of an older mirror.
    old = F.pmod(F.length("title"), F.lit(3))
    rows = rows.withColumn("schema_version", F.when(old == 0, F.lit(None)).when(old == 1, 1).otherwise(F.col("schema_version")).cast("int"))
    rows = rows.select("channel_id", "last_updated", "schema_version", F.col("uploads_count").alias("video_count"), "banner_external_url", "status")
    return V.migrated(rows).select("channel_id", "last_updated", "uploads_count", "schema_version", "migrated").distinct()


def duration_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Durations in seconds, as clock, and the detail they ask for."""
    rows = table(spark, folder, "videos").select("video_id", V.duration_seconds(F.col("duration_data")).alias("seconds")).distinct()
    return rows.select("video_id", "seconds", V.clock(F.col("seconds")).alias("clock"), V.detail_level(F.col("seconds")).alias("level"))


def topic_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of videos by name."""
    rows = table(spark, folder, "videos").select("video_id", F.explode("topic_details.topic_categories").alias("url"))
    return rows.select("video_id", V.topic_category(F.col("url")).alias("category")).distinct()


def age_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Ages of channels at the batch clock, and spans as labels."""
    rows = table(spark, folder, "channels").filter(F.col("published_at").isNotNull()).select("channel_id", "published_at").distinct()
    seconds = F.expr(f"timestampdiff(SECOND, published_at, TIMESTAMP_NTZ'{batch_clock(spark, '2025-03-15 12:00:00')}')")
    days = F.floor(seconds / 86400)
    return rows.select("channel_id", "published_at", V.age_label(days).alias("age"), V.span_label(seconds).alias("span"))


def id_types(spark: SparkSession, folder: str) -> DataFrame:
    """What kind of source each id is."""
    ids = table(spark, folder, "videos").select(F.explode(F.array("video_id", "channel_id")).alias("id")).unionByName(table(spark, folder, "playlists").select(F.col("playlist_id").alias("id")))
    return ids.filter(F.col("id").isNotNull()).distinct().groupBy(V.id_type(F.col("id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def call_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Quota that a log of calls used, by operation."""
    names = list(CALL_COSTS)[:6] + ["thumbnails.set"]
    operation = F.element_at(F.array(*(F.lit(n) for n in names)), (F.pmod("event_id", F.lit(len(names))) + 1).cast("int"))
    rows = table(spark, folder, "events").select(operation.alias("operation"))
    return rows.groupBy("operation").agg(F.sum(V.call_cost(F.col("operation"), CALL_COSTS)).alias("cost"), F.count(F.lit(1)).alias("calls"))


def effort_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Tiers raised along the ladder."""
    tier = F.element_at(F.array(*(F.lit(t) for t in V.EFFORT_LADDER)), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    rows = table(spark, folder, "events").select(tier.alias("tier"), F.pmod("user_id", F.lit(4)).cast("int").alias("bumps"))
    return rows.groupBy("tier", "bumps", V.raise_effort(F.col("tier"), F.col("bumps")).alias("raised")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (text_features, effort_and_technicality, text_predicates, comment_timestamps, anti_signals, handle_botlike, typed_channels, event_properties, schema_migration, duration_labels, topic_categories, age_labels, id_types, call_costs, effort_tiers)}

_S = X.SPACE
_N = lambda p, t="text": f"len(regexp_extract_all({t}, '{p}'))"
_RATIO = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
_PIECES = rf"list_filter(regexp_split_to_array(text, '[.!?]+[{_S}]+|[.!?]+$'), lambda s: regexp_matches(s, '[^{_S}]'))"
_COUNT = rf"CASE WHEN NOT regexp_matches(text, '[^{_S}]') THEN 0 ELSE greatest(1, len({_PIECES})) END"
_TOKENS = rf"list_transform({_PIECES}, lambda s: regexp_extract_all(s, '\p{{L}}+'))"
_LATER = rf"coalesce(list_sum(list_transform({_TOKENS}, lambda t: len(list_filter(t[2:], lambda w: regexp_matches(w, '^[A-Z][a-z]'))))), 0)"
_MID = rf"CASE WHEN length(text) < 30 THEN 0.0 ELSE {_RATIO(_LATER, f'coalesce(list_sum(list_transform({_TOKENS}, lambda t: len(t))), 0)')} END"
_CAPS = _RATIO(_N(r"\p{Lu}"), _N(r"\p{L}"))
_EMOJI = _RATIO(_N(X.EMOJI), "length(text)")
_ANTI = rf"(({_CAPS}) > 0.5 AND length(text) > 10 OR ({_EMOJI}) > 0.2 OR NOT regexp_matches(regexp_replace(text, 'https?://\S+', '', 'g'), '[^{_S}]') AND length(text) > 0)"
_QUAD = lambda v, k: "round(CASE WHEN {v} <= {a} THEN 0.0 WHEN {v} >= {b} THEN 2.5 ELSE 2.5 * (({v} - {a}) / ({b} - {a})) * (({v} - {a}) / ({b} - {a})) END, 1)".format(v=v, a=X.TECHNICAL[k][0], b=X.TECHNICAL[k][1])
_EFFORT_SQL = f"list_value({', '.join(map(repr, X.effort_table()))})[least(greatest(length(text), 60), 600) - 59]"
_TECH_WORDS = "regexp_extract_all(text, '[A-Za-z'']+')"

ORACLE = {
    "text_features": rf"""
SELECT doc_id, length(text)::BIGINT AS length, ({_COUNT})::BIGINT AS sentence_count,
  round({_RATIO("len(list_distinct(regexp_extract_all(lower(text), '[a-z'']+')))", "len(regexp_extract_all(lower(text), '[a-z'']+'))")}, 6) AS type_token_ratio,
  round({_CAPS}, 6) AS caps_ratio, round({_EMOJI}, 6) AS emoji_density, round({_RATIO(_N(r"\p{P}"), "length(text)")}, 6) AS punctuation_ratio, round({_MID}, 6) AS mid_sentence_caps_ratio
FROM documents WHERE text IS NOT NULL""",
    "effort_and_technicality": rf"""
WITH d AS (SELECT doc_id, text, {_COUNT} AS sents, {_MID} AS mid, len({_TECH_WORDS}) AS n, coalesce(list_sum(list_transform({_TECH_WORDS}, lambda w: length(w))), 0) AS letters,
    len(regexp_extract_all(text, '(?i)\b(?:{"|".join(X.DISCOURSE)})\b')) AS marks, len(regexp_extract_all(text, '[{X.SPECIAL_SIGNS}]')) AS signs FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, length(text) >= 200 AND sents >= 1 AND n > 0 AS ok FROM d)
SELECT doc_id, {_EFFORT_SQL}::DOUBLE AS effort, (CASE WHEN sents >= 2 THEN least(5.0, 0.5 * sents) ELSE 0.0 END)::DOUBLE AS sentences,
  (CASE WHEN floor(mid * 100) >= 2 THEN least(5, floor(mid * 100) - 1) ELSE 0 END)::DOUBLE AS caps,
  (CASE WHEN ok THEN {_QUAD("(letters / n)", "word_length")} ELSE 0.0 END)::DOUBLE AS word_length, (CASE WHEN ok THEN {_QUAD("(n / sents)", "sentence_length")} ELSE 0.0 END)::DOUBLE AS sentence_length,
  (CASE WHEN ok THEN {_QUAD("marks", "discourse_markers")} ELSE 0.0 END)::DOUBLE AS discourse_markers, (CASE WHEN ok THEN {_QUAD("(signs / length(text))", "special_signs")} ELSE 0.0 END)::DOUBLE AS special_signs
FROM e""",
    "text_predicates": rf"""
SELECT line, regexp_matches(line, 'https?://|@[\p{{L}}\p{{N}}_]') AS has_link, regexp_matches(line, '^\d{{1,2}}:\d{{2}}') AS has_time,
  regexp_matches(regexp_replace(line, '^[{_S}]+|[{_S}]+$', '', 'g'), '^#\S+(?:\s+#\S+)*$') AS is_hashtags, NOT regexp_matches(line, '[a-zA-Z0-9]') AS is_separator, regexp_matches(line, 'https?://\S+') AS has_url,
  regexp_matches(lower(line), '{"|".join(X.CITATIONS)}') AS has_citation,
  (length(line) - coalesce(list_sum(list_transform(regexp_extract_all(line, 'https?://\S+'), lambda u: greatest(0, length(u) - 20))), 0))::BIGINT AS display_length, count(*) AS n
FROM (SELECT unnest(string_split(description, chr(10))) AS line FROM videos) GROUP BY ALL""",
    "comment_timestamps": r"""
WITH m AS (SELECT comment_id, last_seen, list_filter(regexp_extract_all(text_original, '\b(?:\d{1,2}:)?\d{1,2}:\d{2}\b'), lambda t: CAST(right(t, 2) AS INTEGER) < 60) AS ts FROM comments),
u AS (SELECT comment_id, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS i FROM m)
SELECT DISTINCT comment_id, i::BIGINT AS i, text,
  list_reduce(list_transform(string_split(text, ':'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 60 + b)::BIGINT AS seconds FROM u""",
    "anti_signals": f"SELECT {_ANTI} AS anti, regexp_matches(text, 'https?://\\S+') AS has_url, count(*) AS n FROM (SELECT text_original AS text FROM comments WHERE text_original IS NOT NULL) GROUP BY ALL",
    "handle_botlike": r"""
WITH h AS (SELECT DISTINCT lower(regexp_replace(custom_url, '^@+', '')) AS handle FROM channels WHERE custom_url IS NOT NULL),
l AS (SELECT handle, regexp_replace(handle, '[^\p{L}]', '', 'g') AS letters FROM h)
SELECT handle, array_to_string(list_filter([CASE WHEN regexp_matches(handle, '[0-9]{5,}') THEN 'long digit run' WHEN regexp_matches(handle, '[0-9]{4}[A-Za-z]') THEN 'digits inside' END,
  CASE WHEN regexp_matches(handle, '[bcdfghjklmnpqrstvwxz]{5,}') THEN 'consonant cluster' END,
  CASE WHEN length(letters) >= 6 AND len(regexp_extract_all(letters, '[aeiou]')) / length(letters) < 0.2 THEN 'few vowels' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM l""",
    "typed_channels": rf"""
WITH o AS (SELECT * FROM channels WHERE channel_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY last_updated DESC NULLS LAST, received_at DESC NULLS LAST) = 1)
SELECT channel_id, CASE WHEN regexp_matches(title, '[^{_S}]') THEN title END AS title, CASE WHEN regexp_matches(custom_url, '[^{_S}]') THEN custom_url END AS custom_url,
  {", ".join(f"TRY_CAST(CASE WHEN regexp_matches(regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g'), '^[+-]?[0-9]+$') THEN regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g') END AS BIGINT) AS {c}" for c in ("view_count", "subscriber_count", "uploads_count"))},
  schema_version FROM o""",
    "event_properties": "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.missing.deeper') AS deeper FROM events",
    "schema_migration": "SELECT DISTINCT channel_id, last_updated, uploads_count, 2 AS schema_version, coalesce(length(title) % 3 < 2, false) AS migrated FROM channels WHERE channel_id IS NOT NULL",
    "duration_labels": r"""
WITH d AS (SELECT DISTINCT video_id, coalesce(CASE WHEN regexp_matches(duration_data, '^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$') THEN
    coalesce(TRY_CAST(regexp_extract(duration_data, '(\d+)D', 1) AS BIGINT), 0) * 86400 + coalesce(TRY_CAST(regexp_extract(duration_data, '(\d+)H', 1) AS BIGINT), 0) * 3600
    + coalesce(TRY_CAST(regexp_extract(duration_data, '(\d+)M', 1) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(duration_data, '(\d+)S', 1) AS BIGINT), 0) END, 0)::BIGINT AS seconds FROM videos)
SELECT video_id, seconds, CASE WHEN seconds >= 3600 THEN printf('%d:%02d:%02d', seconds // 3600, seconds % 3600 // 60, seconds % 60) ELSE printf('%d:%02d', seconds // 60, seconds % 60) END AS clock,
  CASE WHEN seconds <= 600 THEN 'short' WHEN seconds > 3600 THEN 'long' ELSE 'medium' END AS level FROM d""",
    "topic_categories": "SELECT DISTINCT video_id, replace(string_split(u, '/')[-1], '_', ' ') AS category FROM (SELECT video_id, unnest(topic_details.topic_categories) AS u FROM videos)",
    "age_labels": """
WITH c AS (SELECT DISTINCT channel_id, published_at, date_diff('microsecond', published_at, TIMESTAMP '2025-03-15 12:00:00') // 1000000 AS s FROM channels WHERE published_at IS NOT NULL),
d AS (SELECT *, s // 86400 AS days FROM c)
SELECT channel_id, published_at, CASE WHEN days < 30 THEN printf('%dd', days) WHEN days < 365 THEN printf('%dmo', days // 30)
    WHEN days % 365 // 30 > 0 THEN printf('%dy %dmo', days // 365, days % 365 // 30) ELSE printf('%dy', days // 365) END AS age,
  CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm %ds', s // 60, s % 60) WHEN s < 86400 THEN printf('%dh %dm', s // 3600, s // 60 % 60) ELSE printf('%dd %dh', s // 86400, s // 3600 % 24) END AS span FROM d""",
    "id_types": r"""
WITH i AS (SELECT DISTINCT id FROM (SELECT video_id AS id FROM videos UNION ALL SELECT channel_id FROM videos UNION ALL SELECT playlist_id FROM playlists) WHERE id IS NOT NULL)
SELECT CASE WHEN regexp_matches(id, '^UC[a-zA-Z0-9_-]{22}$') THEN 'channel' WHEN regexp_matches(id, '^(?:PL|UU|FL|OL|LL|WL|HL|RD|EL)') THEN 'playlist' WHEN regexp_matches(id, '^[a-zA-Z0-9_-]{11}$') THEN 'video' ELSE 'unknown' END AS kind,
  count(*) AS n FROM i GROUP BY 1""",
    "call_costs": """
WITH c AS (SELECT ['search.list', 'videos.list', 'channels.list', 'playlists.list', 'playlistItems.list', 'commentThreads.list', 'thumbnails.set'][event_id % 7 + 1] AS operation FROM events)
SELECT operation, sum(CASE WHEN operation = 'search.list' THEN 100 ELSE 1 END)::BIGINT AS cost, count(*) AS calls FROM c GROUP BY 1""",
    "effort_tiers": """
WITH l AS (SELECT ['none', 'minimal', 'low', 'medium', 'high'] AS l), t AS (SELECT event_id % 5 + 1 AS i, (user_id % 4)::INTEGER AS bumps FROM events)
SELECT l[i] AS tier, bumps, l[greatest(1, least(5, i + bumps))] AS raised, count(*) AS n FROM t, l GROUP BY ALL""",
}
