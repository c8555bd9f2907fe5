"""Sources and sinks of a mirror: documents, logs, captured pages, files."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.values import handle_key, id_type

AUDIO_VIDEO = ("mp4", "mkv", "webm", "mov", "m4a", "mp3", "opus", "ogg", "wav", "flac")


def read_documents(spark: SparkSession, path: str, schema: T.StructType, *, keep_broken: bool = False) -> DataFrame:
    """One JSON document a file, below ``path``; files that can't be read are left out, or kept in _corrupt_record."""
    fields = schema.add("_corrupt_record", T.StringType()) if keep_broken else schema
    mode = "PERMISSIVE" if keep_broken else "DROPMALFORMED"
    return spark.read.schema(fields).option("multiLine", True).option("recursiveFileLookup", True).option("mode", mode).json(path)


def missing(requested: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys asked for that the store doesn't hold: what is to be fetched."""
    return requested.select(key).distinct().join(stored.select(key), key, "left_anti")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines '<time> <id>' as at, id; other lines are left out."""
    parts = F.split(F.col("value"), " ", 2)
    return spark.read.text(path).filter(F.col("value").rlike(r"^\S+ \S")).select(F.try_to_timestamp(parts[0]).alias("at"), parts[1].alias("id")).filter("at IS NOT NULL")


_PAGE = "etag string, nextPageToken string, items array<string>"
_PAGE_FILE = r"/(?:feed=)?([^/]+)/(?:token=([^/]+)/[^/]+|([^/]+)\.json)$"


def _page_numbers(pdf: pd.DataFrame) -> pd.DataFrame:
    """The numbers of a feed's pages, from 'first' on by their next tokens; pages that nothing leads to have none."""
    after, token, number = dict(zip(pdf["token"], pdf["next"])), "first", {}
    while token in after and token not in number:
        number[token] = len(number)
        token = after[token]
    return pd.DataFrame({"feed": pdf["feed"].iloc[0] if len(pdf) else None, "token": list(number), "page": list(number.values())})


def read_pages(spark: SparkSession, path: str, etag: str | None = None, known: DataFrame | None = None, *, lines: bool = False) -> DataFrame:
    """Items of captured pages of an interface: feed, page, position, item (JSON), etag.

    ``path`` holds <feed>/<token>.json, or feed=<feed>/token=<token>/ with a file,
    on any file system Spark reads; with ``lines`` files of a page a line, which
    names its feed and token itself, so that many pages share a file. Pages follow each other from 'first' on by
    nextPageToken. A feed whose first page has the tag ``etag``, or the one that
    ``known`` (feed, etag) has for it, is unchanged and left out. The chain of a
    feed is worked from its tokens alone.
    """
    if lines:
        raw, feed, token = spark.read.schema(f"feed string, token string, {_PAGE}").json(path), F.col("feed"), F.col("token")
    else:
        raw = spark.read.schema(_PAGE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
        part = lambda n: F.nullif(F.regexp_extract(F.col("_metadata.file_path"), _PAGE_FILE, n), F.lit(""))
        feed, token = part(1), F.coalesce(part(2), part(3))
    pages = raw.select(feed.alias("feed"), token.alias("token"), F.col("nextPageToken").alias("next"), "etag", "items").filter("feed IS NOT NULL AND token IS NOT NULL")
    first = pages.filter("token = 'first'").select("feed", "etag")
    if etag is not None:
        pages = pages.join(first.filter(F.col("etag") == etag).select("feed"), "feed", "left_anti")
    if known is not None:
        pages = pages.join(first.join(known, ["feed", "etag"], "left_semi").select("feed"), "feed", "left_anti")
    numbers = pages.select("feed", "token", "next").groupBy("feed").applyInPandas(_page_numbers, "feed string, token string, page int")
    return pages.join(numbers, ["feed", "token"]).select("feed", "page", F.posexplode("items").alias("position", "item"), "etag").select("feed", "page", "position", "item", "etag")


_COMMENT = "struct<id:string,snippet:struct<parentId:string,textOriginal:string,likeCount:bigint,publishedAt:string,authorChannelId:struct<value:string>>>"
THREAD = f"struct<id:string,snippet:struct<videoId:string,totalReplyCount:bigint,topLevelComment:{_COMMENT}>,replies:struct<comments:array<{_COMMENT}>>>"


def flatten_threads(threads: DataFrame, thread: str = "thread") -> DataFrame:
    """Rows of comments from nested threads: the top comment, then its replies; what is missing is null."""
    t = F.col(thread)

    def row(c: Column, parent: Column, replies: Column) -> Column:
        s = c["snippet"]
        return F.struct(
            c["id"].alias("comment_id"), parent.alias("parent_id"), s["authorChannelId"]["value"].alias("author_channel_id"), s["textOriginal"].alias("text_original"),
            s["likeCount"].alias("like_count"), s["publishedAt"].alias("published_at"), replies.alias("total_reply_count"),
        )

    top = F.array(row(t["snippet"]["topLevelComment"], F.lit(None).cast("string"), t["snippet"]["totalReplyCount"]))
    replies = F.transform(F.coalesce(t["replies"]["comments"], F.array().cast(f"array<{_COMMENT}>")), lambda c: row(c, F.coalesce(c["snippet"]["parentId"], t["id"]), F.lit(0).cast("bigint")))
    return threads.select(t["snippet"]["videoId"].alias("video_id"), F.posexplode(F.concat(top, replies)).alias("ordinal", "c")).select("video_id", "ordinal", "c.*")


_THUMBNAILS = "map<string,struct<url:string>>"
# Nested items as the interface gives them.
RAW_VIDEO = f"""struct<id:string,
  snippet:struct<title:string,channelId:string,publishedAt:string,description:string,thumbnails:{_THUMBNAILS},tags:array<string>,categoryId:string,liveBroadcastContent:string>,
  contentDetails:struct<duration:string,dimension:string,definition:string,caption:string,licensedContent:boolean,projection:string>,
  status:struct<privacyStatus:string,license:string,embeddable:boolean,publicStatsViewable:boolean,madeForKids:boolean>,
  statistics:struct<viewCount:string,likeCount:string,commentCount:string>, topicDetails:struct<topicCategories:array<string>>, liveStreamingDetails:struct<scheduledStartTime:string,activeLiveChatId:string>>"""
RAW_CHANNEL = f"""struct<id:string,
  snippet:struct<title:string,customUrl:string,description:string,publishedAt:string,thumbnails:{_THUMBNAILS}>,
  contentDetails:struct<relatedPlaylists:map<string,string>>, statistics:struct<viewCount:string,subscriberCount:string,videoCount:string>,
  topicDetails:struct<topicCategories:array<string>>, brandingSettings:struct<image:struct<bannerExternalUrl:string>>>"""
_VIDEO_PATHS = {
    "video_id": "id", "title": "snippet.title", "channel_id": "snippet.channelId", "published_at": "snippet.publishedAt", "description": "snippet.description", "thumbnails_data": "snippet.thumbnails",
    "tags": "snippet.tags", "category_id": "snippet.categoryId", "live_status": "snippet.liveBroadcastContent", "live_start": "liveStreamingDetails.scheduledStartTime", "live_chat_id": "liveStreamingDetails.activeLiveChatId",
    "duration_data": "contentDetails.duration", "spatial_dimension_type": "contentDetails.dimension", "resolution_tier": "contentDetails.definition", "captioned": "contentDetails.caption",
    "licensed_content": "contentDetails.licensedContent", "viewing_projection": "contentDetails.projection", "privacy_status": "status.privacyStatus", "license": "status.license", "embeddable": "status.embeddable",
    "public_stats_viewable": "status.publicStatsViewable", "made_for_kids": "status.madeForKids", "view_count": "statistics.viewCount", "like_count": "statistics.likeCount", "comment_count": "statistics.commentCount",
    "topic_categories": "topicDetails.topicCategories",
}
_CHANNEL_PATHS = {
    "channel_id": "id", "title": "snippet.title", "custom_url": "snippet.customUrl", "description": "snippet.description", "published_at": "snippet.publishedAt", "thumbnails": "snippet.thumbnails",
    "playlists_data": "contentDetails.relatedPlaylists", "view_count": "statistics.viewCount", "subscriber_count": "statistics.subscriberCount", "uploads_count": "statistics.videoCount",
    "topic_categories": "topicDetails.topicCategories", "banner_external_url": "brandingSettings.image.bannerExternalUrl",
}


def _flat(items: DataFrame, item: str, shape: str, paths: dict[str, str]) -> DataFrame:
    rows = items.select(F.from_json(item, shape).alias("i")).filter("i.id IS NOT NULL")
    time = lambda name, c: F.try_to_timestamp(c).cast("timestamp_ntz") if name.endswith(("_at", "_start")) else c
    return rows.select(*(time(name, F.col(f"i.{path}")).alias(name) for name, path in paths.items()))


def flatten_videos(items: DataFrame, item: str = "item") -> DataFrame:
    """Rows of videos from raw JSON items; what is missing is null, an item without id or that can't be read is left out."""
    return _flat(items, item, RAW_VIDEO, _VIDEO_PATHS)


def flatten_channels(items: DataFrame, item: str = "item") -> DataFrame:
    """Rows of channels from raw JSON items, likewise."""
    return _flat(items, item, RAW_CHANNEL, _CHANNEL_PATHS)


def map_rows(df: DataFrame, key: str, values: str) -> DataFrame:
    """The entries of a map as rows, in its order: ``key``, ordinal, name, value."""
    return df.select(key, F.posexplode(F.map_entries(values)).alias("ordinal", "e")).select(key, "ordinal", F.col("e.key").alias("name"), F.col("e.value").alias("value"))


def by_handle(requested: DataFrame, channels: DataFrame, handle: str = "handle") -> DataFrame:
    """Each requested handle with the channel that has it (the first by id), without regard to @ and case; null if it is to be asked for."""
    held = channels.filter(F.col("custom_url").isNotNull() & F.col("channel_id").isNotNull()).groupBy(handle_key(F.col("custom_url")).alias("__h")).agg(F.min("channel_id").alias("channel_id"))
    return requested.select(handle).distinct().join(held, handle_key(F.col(handle)) == F.col("__h"), "left").drop("__h")


def videos_of(sources: DataFrame, videos: DataFrame, playlists: DataFrame, source: str = "source_id") -> DataFrame:
    """The videos behind ids of any kind: a video itself, the uploads of a channel, the items of a playlist. Other ids give none.

    ``videos``: video_id, channel_id; ``playlists``: playlist_id, items.
    """
    asked = sources.select(source).distinct().withColumn("kind", id_type(F.col(source)))
    own = asked.filter("kind = 'video'").join(videos.select(F.col("video_id").alias(source)).distinct(), source, "left_semi").withColumn("video_id", F.col(source))
    uploads = asked.filter("kind = 'channel'").join(videos.select(F.col("channel_id").alias(source), "video_id").distinct(), source)
    items = asked.filter("kind = 'playlist'").join(playlists.select(F.col("playlist_id").alias(source), F.explode("items").alias("video_id")), source)
    return own.unionByName(uploads).unionByName(items).distinct()


def find_files(spark: SparkSession, path: str, part_of_name: str, endings: Sequence[str] = AUDIO_VIDEO) -> DataFrame:
    """Files below ``path`` with a part of the name and a known ending: path, length, modified. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{part_of_name}*").load(path)
    return rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings)).select("path", "length", F.col("modificationTime").alias("modified"))


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, at: str, key: str) -> None:
    """Rows appended as '<time> <id>', oldest first within a file."""
    line = F.concat_ws(" ", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col(key).cast("string"))
    df.sortWithinPartitions(at, key).select(line.alias("value")).write.mode("append").text(path)


def write_by_year(df: DataFrame, path: str, at: str) -> None:
    """Only the years that ``df`` holds are replaced."""
    df.withColumn("year", F.year(at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def archive_removed(stored: DataFrame, removed: DataFrame, key: str, active: str, archive: str) -> None:
    """Rows of ``removed`` (with removed_at) are appended to the archive; the rest is the new active table."""
    removed.write.mode("append").parquet(archive)
    stored.join(removed.select(key), key, "left_anti").write.mode("overwrite").parquet(active)
