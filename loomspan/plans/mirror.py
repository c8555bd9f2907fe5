"""Queries of sources and sinks: documents, pages, raw items, logs, files, look-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspan.functions import values as V
from loomspan.functions.text import sentence_pieces, strip
from loomspan.operators import blocks as B
from loomspan.operators import media as M
from loomspan.operators.latest import latest_row
from loomspan.operators.quality import current_channels
from loomspan.plans.archives import CLOCK
from loomspan.session import batch_clock, shared_folder
from loomspan.sources import mirror as S
from loomspan.sources.tables import table

#: Items of a captured page.
PAGE = 10


def _work(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/mirror-{uuid.uuid4().hex}"


def _videos(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "videos").filter("video_id IS NOT NULL")
    return latest_row(rows, ["video_id"], [F.col(c).desc_nulls_last() for c in ("last_updated", "channel_id", "view_count", "title")])


def _playlists(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each playlist of all snapshots."""
    rows = table(spark, folder, "playlists").filter("playlist_id IS NOT NULL")
    return latest_row(rows, ["playlist_id"], [F.col("snapshot_date").desc_nulls_last(), F.col("last_updated").desc_nulls_last(), F.col("items").isNull(), F.col("etag").desc_nulls_last()])


def read_through(spark: SparkSession, folder: str) -> DataFrame:
    """Ids asked for, with the title the mirror holds; those it doesn't hold are to be fetched."""
    ids = [table(spark, folder, t).select(c.alias("video_id")) for t, c in (("video_updates", F.col("video_id")), ("playlists", F.explode("items")), ("comments", F.col("video_id")), ("channels", F.substring("channel_id", 3, 11)))]
    asked = ids[0].unionByName(ids[1]).unionByName(ids[2]).unionByName(ids[3]).filter("video_id IS NOT NULL").distinct()
    held = _videos(spark, folder).select("video_id", "title", F.lit(True).alias("held"))
    return asked.join(held, "video_id", "left").select("video_id", "title", F.coalesce("held", F.lit(False)).alias("held"))


def current_schema_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Channels whose stored document is of the present version; every third is taken for one of an older mirror and isn't given out."""
    one = current_channels(table(spark, folder, "channels"))
    version = F.when(F.length("title") % 3 == 0, F.col("schema_version") - 1).otherwise(F.col("schema_version"))
    return one.withColumn("version", version).filter(F.col("version") >= V.SCHEMA_VERSION).select("channel_id", "version")


_PLAYLIST = T.StructType([T.StructField(n, k) for n, k in (("playlist_id", T.StringType()), ("channel_id", T.StringType()), ("title", T.StringType()), ("item_count", T.LongType()), ("items", T.ArrayType(T.StringType())), ("published_at", T.TimestampNTZType()))])


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Playlists written as JSON documents and read again."""
    at = _work(spark)
    S.write_documents(_playlists(spark, folder).select(*_PLAYLIST.names), at)
    return spark.read.schema(_PLAYLIST).json(at)


def playlist_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Playlists after the way through JSON documents, times as ISO text in them."""
    return _documents(spark, folder).select("playlist_id", "channel_id", "title", "item_count", F.array_join("items", ",").alias("items"), "published_at")


def playlists_of_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Each channel with the playlists the mirror holds; where it holds none they are to be fetched."""
    held = _documents(spark, folder).groupBy("channel_id").agg(F.count(F.lit(1)).alias("playlists"))
    one = current_channels(table(spark, folder, "channels")).select("channel_id")
    return one.join(held, "channel_id", "left").select("channel_id", F.coalesce("playlists", F.lit(0)).alias("playlists"), F.when(F.col("playlists").isNull(), "remote").otherwise("local").alias("source"))


def uploads_newest_first(spark: SparkSession, folder: str) -> DataFrame:
    """A channel's uploads year by year, the latest year first, and within a year the newest first."""
    rows = _videos(spark, folder).filter("channel_id IS NOT NULL AND published_at IS NOT NULL").select("channel_id", "video_id", "published_at", F.year("published_at").alias("year"))
    newest = rows.withColumn("place", F.row_number().over(Window.partitionBy("channel_id", "year").orderBy(F.col("published_at").desc(), "video_id")) - 1)
    return newest.orderBy("channel_id", F.col("year").desc(), "place").select("channel_id", "year", "place", "video_id")


def map_entries_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The playlists a channel names, as rows in their order."""
    return S.map_rows(current_channels(table(spark, folder, "channels")), "channel_id", "playlists_data")


def handle_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Handles found among the channels whatever their case; those that aren't are to be asked for."""
    channels = table(spark, folder, "channels")
    asked = channels.filter("custom_url IS NOT NULL").select(F.upper("custom_url").alias("handle")).unionByName(table(spark, folder, "comments").filter("author_display_name LIKE '@%'").select(F.col("author_display_name").alias("handle")))
    return S.by_handle(asked, channels).select("handle", "channel_id")


def source_videos(spark: SparkSession, folder: str) -> DataFrame:
    """The videos behind ids of videos, channels and playlists."""
    videos, playlists = _videos(spark, folder), _playlists(spark, folder)
    ids = videos.select(F.explode(F.array("video_id", "channel_id")).alias("source_id")).unionByName(playlists.select(F.col("playlist_id").alias("source_id"))).filter("source_id IS NOT NULL")
    return S.videos_of(ids, videos, playlists)


def _pages(spark: SparkSession, folder: str) -> str:
    """Playlists as captured pages: a feed each, PAGE items a page, each page naming the next."""
    rows = _playlists(spark, folder).filter("size(items) > 0").select("playlist_id", "items_etag", "items")
    count = F.ceil(F.size("items") / PAGE)
    cut = rows.select("playlist_id", "items_etag", "items", F.explode(F.sequence(F.lit(0), count - 1)).alias("page"), count.alias("pages"))
    token = lambda n: F.when(n == 0, "first").otherwise(F.concat(F.lit("t"), n.cast("string")))
    page = F.to_json(F.struct(
        F.col("playlist_id").alias("feed"), token(F.col("page")).alias("token"),
        F.concat_ws("-", F.coalesce("items_etag", F.lit("e")), "page").alias("etag"), F.when(F.col("page") + 1 < F.col("pages"), token(F.col("page") + 1)).alias("nextPageToken"),
        F.transform(F.slice("items", F.col("page").cast("int") * PAGE + 1, PAGE), lambda v: F.struct(v.alias("videoId"))).alias("items"),
    ))
    at = _work(spark)
    cut.select(page.alias("value")).write.text(at)
    return at


def page_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items of all captured pages in the order of their tokens."""
    return S.read_pages(spark, _pages(spark, folder), lines=True).select("feed", "page", "position", F.get_json_object("item", "$.videoId").alias("video_id"))


def changed_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the feeds whose first tag isn't the one known already."""
    known = _playlists(spark, folder).filter("length(title) % 2 = 0").select(F.col("playlist_id").alias("feed"), F.concat(F.coalesce("items_etag", F.lit("e")), F.lit("-0")).alias("etag"))
    return S.read_pages(spark, _pages(spark, folder), known=known, lines=True).groupBy("feed").agg(F.count(F.lit(1)).alias("items"))


def flattened_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Raw items of videos, as the interface nests them, made rows."""
    c, iso = F.col, lambda n: F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.to_json(F.struct(
        c("video_id").alias("id"), F.struct("title", c("channel_id").alias("channelId"), iso("published_at").alias("publishedAt"), "description", c("thumbnails_data").alias("thumbnails"), "tags", c("category_id").alias("categoryId"), c("live_status").alias("liveBroadcastContent")).alias("snippet"),
        F.struct(c("duration_data").alias("duration"), c("captioned").alias("caption"), c("licensed_content").alias("licensedContent")).alias("contentDetails"), F.struct(c("privacy_status").alias("privacyStatus"), c("made_for_kids").alias("madeForKids")).alias("status"),
        F.struct(c("view_count").alias("viewCount"), c("like_count").alias("likeCount")).alias("statistics"), F.struct(c("topic_details.topic_categories").alias("topicCategories")).alias("topicDetails"),
    ))
    rows = S.flatten_videos(_videos(spark, folder).select(raw.alias("item")))
    return rows.select(
        "video_id", "title", "channel_id", "published_at", F.col("thumbnails_data")["default"]["url"].alias("thumbnail"), F.array_join("tags", "|").alias("tags"), "category_id", "live_status", "duration_data", "captioned",
        "licensed_content", "license", "privacy_status", "made_for_kids", "view_count", "like_count", "comment_count", F.array_join("topic_categories", "|").alias("topics"),
    )


def flattened_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Raw items of channels made rows."""
    c = F.col
    raw = F.to_json(F.struct(
        c("channel_id").alias("id"), F.struct("title", c("custom_url").alias("customUrl"), "description", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("publishedAt"), "thumbnails").alias("snippet"),
        F.struct(c("playlists_data").alias("relatedPlaylists")).alias("contentDetails"), F.struct(c("view_count").alias("viewCount"), c("uploads_count").alias("videoCount")).alias("statistics"),
        F.struct(F.struct(c("banner_external_url").alias("bannerExternalUrl")).alias("image")).alias("brandingSettings"),
    ))
    rows = S.flatten_channels(current_channels(table(spark, folder, "channels")).select(raw.alias("item")))
    return rows.select("channel_id", "title", "custom_url", "description", "published_at", F.col("thumbnails")["default"]["url"].alias("thumbnail"), F.col("playlists_data")["uploads"].alias("uploads"), "view_count", "uploads_count", "subscriber_count", "banner_external_url")


def rating_log(spark: SparkSession, folder: str) -> DataFrame:
    """A log of times and ids, appended to in two runs and read again."""
    rows, at = table(spark, folder, "events").select("ts", "event_id"), _work(spark)
    S.append_log(rows.filter("event_type = 'view'"), at, "ts", "event_id")
    S.append_log(rows.filter("event_type <> 'view'"), at, "ts", "event_id")
    return S.read_log(spark, at).select(F.col("at").cast("timestamp_ntz").alias("at"), "id")


def media_probe(spark: SparkSession, folder: str) -> DataFrame:
    """The first video and audio stream of files, from what a probe printed as JSON."""
    stream = lambda kind, codec, **more: F.struct(F.lit(kind).alias("codec_type"), codec.alias("codec_name"), *(F.lit(more.get(k)).cast("int").alias(k) for k in ("width", "height", "channels")))
    size = F.col("p_size")
    parts = F.array(F.when(size % 3 != 0, stream("video", F.col("p_brand"), width=640, height=360)), F.when(size % 2 == 0, stream("audio", F.lit("opus"), channels=2)), stream("video", F.lit("second"), width=1, height=1), stream("subtitle", F.lit("srt")))
    printed = table(spark, folder, "part").select("p_partkey", F.to_json(F.struct(F.array_compact(parts).alias("streams"))).alias("text"))
    shape = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,channels:int>>"
    return printed.select("p_partkey", M.probe(F.from_json("text", shape)["streams"]).alias("p")).select("p_partkey", "p.*")


def found_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a part of the name and a known ending, below folders by brand."""
    at = _work(spark)
    rows = table(spark, folder, "part").select("p_brand", F.col("p_name").alias("value")).repartition("p_brand")
    rows.write.partitionBy("p_brand").text(at)
    return S.find_files(spark, at, "part-", endings=("txt",)).select(F.regexp_extract("path", r"p_brand=([^/]+)/", 1).alias("brand")).distinct().withColumn("brand", F.url_decode(F.replace("brand", F.lit("+"), F.lit("%2B"))))


def media_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Where a file is: by pointer, else in the folder, else located by id, else by a title of some length; null if it is to be fetched."""
    n, name = F.col("p_size"), F.col("p_name")
    path = lambda kind: F.concat(F.lit(f"/{kind}/"), F.col("p_partkey").cast("string"))
    found = M.found_by(("pointer", F.when(n % 5 == 0, path("pointer"))), ("folder", F.when(n % 4 == 0, path("folder"))), ("located", F.when(n % 3 == 0, path("located"))), ("title", F.when((n % 2 == 0) & (F.length(name) >= 10), path("title"))))
    return table(spark, folder, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.found_via", "f.path")


def uploads_year_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads flushed by year in two runs, of which the second replaces only the years it holds."""
    at = _work(spark)
    rows = _videos(spark, folder).filter("published_at IS NOT NULL").select("video_id", "published_at", F.lit(1).alias("run"))
    S.write_by_year(rows, at, "published_at")
    S.write_by_year(rows.filter("year(published_at) % 2 = 0").withColumn("run", F.lit(2)), at, "published_at")
    return spark.read.schema("video_id string, published_at timestamp_ntz, run int, year int").parquet(at).groupBy("year", "run").agg(F.count(F.lit(1)).alias("videos"))


def archived_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Channels moved to the archive with the time they were removed, and those that stay."""
    at = _work(spark)
    stored = current_channels(table(spark, folder, "channels")).select("channel_id", "title")
    kept = table(spark, folder, "playlists").select("channel_id").filter("channel_id IS NOT NULL").distinct()
    gone = stored.join(kept, "channel_id", "left_anti").withColumn("removed_at", F.lit(batch_clock(spark, CLOCK)).cast("timestamp_ntz"))
    S.archive_removed(stored, gone, "channel_id", f"{at}/active", f"{at}/archive")
    active = spark.read.schema(stored.schema).parquet(f"{at}/active").withColumn("removed_at", F.lit(None).cast("timestamp_ntz"))
    return active.unionByName(spark.read.schema(gone.schema).parquet(f"{at}/archive"))


def derived_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions without boilerplate, written with the version of the rules and the video's own time, and read again."""
    at, v = _work(spark), _videos(spark, folder)
    out = B.strip_boilerplate(v).join(v.select("video_id", "last_updated"), "video_id").withColumn("rules", F.lit(B.VERSION))
    out.write.mode("overwrite").parquet(at)
    rows = spark.read.schema(out.schema).parquet(at)
    return rows.select("video_id", F.coalesce(F.length("description"), F.lit(-1)).alias("characters"), "last_updated", "rules")


def text_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of comments between end marks."""
    rows = table(spark, folder, "comments").filter("comment_id IS NOT NULL AND text_original IS NOT NULL").select("comment_id", "text_original").distinct()
    return rows.select("comment_id", F.posexplode(sentence_pieces(F.col("text_original"))).alias("place", "s")).select("comment_id", "place", strip(F.col("s")).alias("sentence"))


def first_playlists(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten playlists of a channel by title, and whether there are more."""
    w = Window.partitionBy("channel_id")
    rows = _playlists(spark, folder).filter("channel_id IS NOT NULL").select("channel_id", "playlist_id", "title")
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(F.col("title").asc_nulls_last(), "playlist_id"))).withColumn("more", F.count(F.lit(1)).over(w) > 10)
    return ranked.filter("place <= 10")


QUERIES = {f.__name__: f for f in (
    read_through, current_schema_channels, playlist_documents, playlists_of_channels, uploads_newest_first, map_entries_scan, handle_lookup, source_videos, page_items, changed_feeds, flattened_videos, flattened_channels, rating_log,
    media_probe, found_files, media_lookup, uploads_year_sink, archived_entities, derived_descriptions, text_sentences, first_playlists,
)}

_V = "v AS (SELECT * FROM videos WHERE video_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY last_updated DESC NULLS LAST, channel_id DESC NULLS LAST, view_count DESC NULLS LAST, title DESC NULLS LAST) = 1)"
_P = "p AS (SELECT * FROM playlists WHERE playlist_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY snapshot_date DESC NULLS LAST, last_updated DESC NULLS LAST, items IS NULL, etag DESC NULLS LAST) = 1)"
_C = "ch AS (SELECT * FROM channels WHERE channel_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY last_updated DESC NULLS LAST, received_at DESC NULLS LAST) = 1)"
_KIND = r"CASE WHEN regexp_matches({0}, '^UC[a-zA-Z0-9_-]{{22}}$') THEN 'channel' WHEN regexp_matches({0}, '^(?:PL|UU|FL|OL|LL|WL|HL|RD|EL)') THEN 'playlist' WHEN regexp_matches({0}, '^[a-zA-Z0-9_-]{{11}}$') THEN 'video' ELSE 'unknown' END"


def _oracle() -> dict[str, str]:
    from loomspan.functions import text as X
    from loomspan.plans import descriptions as D

    kind = _KIND.format("source_id")
    return {
        "read_through": f"WITH {_V}, a AS (SELECT video_id FROM video_updates UNION SELECT unnest(items) FROM playlists UNION SELECT video_id FROM comments UNION SELECT substring(channel_id, 3, 11) FROM channels) SELECT video_id, title, v.video_id IS NOT NULL AS held FROM a LEFT JOIN v USING (video_id) WHERE video_id IS NOT NULL",
        "current_schema_channels": f"WITH {_C} SELECT channel_id, schema_version AS version FROM ch WHERE length(title) % 3 <> 0 OR title IS NULL",
        "playlist_documents": f"WITH {_P} SELECT playlist_id, channel_id, title, item_count, array_to_string(items, ',') AS items, published_at FROM p",
        "playlists_of_channels": f"WITH {_P}, {_C}, n AS (SELECT channel_id, count(*) AS k FROM p GROUP BY 1) SELECT channel_id, coalesce(k, 0) AS playlists, CASE WHEN k IS NULL THEN 'remote' ELSE 'local' END AS source FROM ch LEFT JOIN n USING (channel_id)",
        "uploads_newest_first": f"WITH {_V} SELECT channel_id, year(published_at)::INTEGER AS year, (row_number() OVER (PARTITION BY channel_id, year(published_at) ORDER BY published_at DESC, video_id) - 1)::INTEGER AS place, video_id FROM v WHERE channel_id IS NOT NULL AND published_at IS NOT NULL",
        "map_entries_scan": f"WITH {_C}, e AS (SELECT channel_id, map_entries(playlists_data) AS es FROM ch), u AS (SELECT channel_id, generate_subscripts(es, 1) - 1 AS ordinal, unnest(es) AS e FROM e) SELECT channel_id, ordinal::INTEGER AS ordinal, e.key AS name, e.value AS value FROM u",
        "handle_lookup": """WITH a AS (SELECT upper(custom_url) AS handle FROM channels WHERE custom_url IS NOT NULL UNION SELECT author_display_name FROM comments WHERE author_display_name LIKE '@%'),
  h AS (SELECT lower(regexp_replace(custom_url, '^@+', '')) AS k, min(channel_id) AS channel_id FROM channels WHERE custom_url IS NOT NULL AND channel_id IS NOT NULL GROUP BY 1)
  SELECT handle, channel_id FROM a LEFT JOIN h ON k = lower(regexp_replace(handle, '^@+', ''))""",
        "source_videos": f"""WITH {_V}, {_P}, a AS (SELECT video_id AS source_id FROM v UNION SELECT channel_id FROM v UNION SELECT playlist_id FROM p), k AS (SELECT source_id, {kind} AS kind FROM a WHERE source_id IS NOT NULL)
  SELECT source_id, kind, source_id AS video_id FROM k WHERE kind = 'video' UNION SELECT source_id, kind, v.video_id FROM k JOIN v ON v.channel_id = source_id WHERE kind = 'channel' UNION SELECT source_id, kind, unnest(items) FROM k JOIN p ON p.playlist_id = source_id WHERE kind = 'playlist'""",
        "page_items": f"WITH {_P}, u AS (SELECT playlist_id AS feed, generate_subscripts(items, 1) - 1 AS n, unnest(items) AS video_id FROM p) SELECT feed, (n // {PAGE})::INTEGER AS page, (n % {PAGE})::INTEGER AS position, video_id FROM u",
        "changed_feeds": f"WITH {_P} SELECT playlist_id AS feed, len(items) AS items FROM p WHERE len(items) > 0 AND (length(title) % 2 <> 0 OR title IS NULL)",
        "flattened_videos": f"""WITH {_V} SELECT video_id, title, channel_id, published_at, thumbnails_data['default'].url AS thumbnail, array_to_string(tags, '|') AS tags, category_id, live_status, duration_data, captioned, licensed_content, NULL::VARCHAR AS license,
  privacy_status, made_for_kids, view_count, like_count, NULL::VARCHAR AS comment_count, array_to_string(topic_details.topic_categories, '|') AS topics FROM v""",
        "flattened_channels": f"WITH {_C} SELECT channel_id, title, custom_url, description, published_at, thumbnails['default'].url AS thumbnail, playlists_data['uploads'] AS uploads, view_count, uploads_count, NULL::VARCHAR AS subscriber_count, banner_external_url FROM ch",
        "rating_log": "SELECT ts AS at, event_id::VARCHAR AS id FROM events",
        "media_probe": """SELECT p_partkey, true AS has_video, CASE WHEN p_size % 3 <> 0 THEN p_brand ELSE 'second' END AS video_codec, CASE WHEN p_size % 3 <> 0 THEN 640 ELSE 1 END AS width, CASE WHEN p_size % 3 <> 0 THEN 360 ELSE 1 END AS height,
  p_size % 2 = 0 AS has_audio, CASE WHEN p_size % 2 = 0 THEN 'opus' END AS audio_codec, CASE WHEN p_size % 2 = 0 THEN 2 END AS channels FROM part""",
        "found_files": "SELECT DISTINCT p_brand AS brand FROM part",
        "media_lookup": """WITH f AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'pointer' WHEN p_size % 4 = 0 THEN 'folder' WHEN p_size % 3 = 0 THEN 'located' WHEN p_size % 2 = 0 AND length(p_name) >= 10 THEN 'title' END AS found_via FROM part)
  SELECT p_partkey, found_via, '/' || found_via || '/' || p_partkey AS path FROM f""",
        "uploads_year_sink": f"WITH {_V} SELECT year(published_at)::INTEGER AS year, CASE WHEN year(published_at) % 2 = 0 THEN 2 ELSE 1 END AS run, count(*) AS videos FROM v WHERE published_at IS NOT NULL GROUP BY ALL",
        "archived_entities": f"WITH {_C} SELECT channel_id, title, CASE WHEN channel_id NOT IN (SELECT channel_id FROM playlists WHERE channel_id IS NOT NULL) THEN TIMESTAMP '{CLOCK}' END AS removed_at FROM ch",
        "derived_descriptions": f"WITH s AS ({D.ORACLE['strip_boilerplate']}), {_V} SELECT video_id, coalesce(length(s.description), -1)::INTEGER AS characters, last_updated, {B.VERSION} AS rules FROM s JOIN v USING (video_id)",
        "text_sentences": rf"""WITH c AS (SELECT DISTINCT comment_id, text_original AS text FROM comments WHERE comment_id IS NOT NULL AND text_original IS NOT NULL), l AS (SELECT comment_id, list_filter(regexp_split_to_array(text, '[.!?]+[{X.SPACE}]+|[.!?]+$'), lambda s: regexp_matches(s, '[^{X.SPACE}]')) AS ss FROM c),
  u AS (SELECT comment_id, generate_subscripts(ss, 1) - 1 AS place, unnest(ss) AS s FROM l) SELECT comment_id, place::INTEGER AS place, regexp_replace(s, '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g') AS sentence FROM u""",
        "first_playlists": f"WITH {_P} SELECT channel_id, playlist_id, title, (row_number() OVER w)::INTEGER AS place, count(*) OVER (PARTITION BY channel_id) > 10 AS more FROM p WHERE channel_id IS NOT NULL WINDOW w AS (PARTITION BY channel_id ORDER BY title NULLS LAST, playlist_id) QUALIFY row_number() OVER w <= 10",
    }


ORACLE = _oracle()
