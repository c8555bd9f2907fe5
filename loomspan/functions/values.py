"""Coercion, time and display functions as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.text import is_blank, strip

EFFORT_LADDER = ("none", "minimal", "low", "medium", "high")


def bare(value: Column) -> Column:
    """Null, empty and blank text are all null."""
    return F.when(is_blank(value), None).otherwise(value)


def to_int(value: Column) -> Column:
    return strip(value).try_cast("bigint")


def to_bool(value: Column) -> Column:
    """true, yes, 1 and on, in any case, are true; any other text is false."""
    return F.when(bare(value).isNull(), None).otherwise(F.lower(strip(value)).isin("true", "yes", "1", "on"))


def to_time(value: Column) -> Column:
    return F.try_to_timestamp(strip(value))


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns as the schema has them; what can't be read is null, what the schema lacks is dropped, what it has besides is null."""
    how = {T.LongType: to_int, T.IntegerType: lambda c: to_int(c).cast("int"), T.BooleanType: to_bool, T.TimestampType: to_time}
    have = dict(df.dtypes)

    def column(field: T.StructField) -> Column:
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if have[field.name] == "string":
            value = how.get(type(field.dataType), bare)(value)
        return value.cast(field.dataType).alias(field.name)

    return df.select(*(column(f) for f in schema.fields))


SCHEMA_VERSION = 2


def migrated(channels: DataFrame) -> DataFrame:
    """Channels of any known schema version brought to the present one, with migrated: whether they were older.

    Rows without version, or of 0 or 1, lose banner_external_url and status, and
    their video_count is uploads_count now. A version that isn't known fails the query.
    """
    version = F.col("schema_version")
    known = F.when(version.isNull() | version.isin(0, 1), True).when(version == SCHEMA_VERSION, False)
    failed = F.raise_error(F.concat(F.lit("unknown schema version: "), version.cast("string"))).cast("boolean")
    rows = channels.withColumn("migrated", F.coalesce(known, failed)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    return rows.withColumnRenamed("video_count", "uploads_count").drop("banner_external_url", "status")


def duration_seconds(iso: Column) -> Column:
    """Seconds of an ISO 8601 duration of days, hours, minutes and seconds; 0 where it can't be read."""
    form = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda n: F.coalesce(F.nullif(F.regexp_extract(iso, form, n), F.lit("")).cast("bigint"), F.lit(0))
    return F.coalesce(F.when(iso.rlike(form), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)), F.lit(0)).cast("bigint")


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def topic_category(url: Column) -> Column:
    return F.translate(F.element_at(F.split(url, "/"), -1), "_", " ")


def one_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\t\n\r", "   "))


def age_label(days: Column) -> Column:
    """Days under a month, months under a year, years and months beyond."""
    months = F.floor(days % 365 / 30)
    years = F.floor(days / 365)
    return (
        F.when(days < 30, F.format_string("%dd", days)).when(days < 365, F.format_string("%dmo", F.floor(days / 30)))
        .when(months > 0, F.format_string("%dy %dmo", years, months)).otherwise(F.format_string("%dy", years))
    )


def span_label(seconds: Column) -> Column:
    """Two units at most: s, m s, h m, d h."""
    n = lambda unit: F.floor(seconds / unit).cast("bigint")
    return (
        F.when(seconds < 60, F.format_string("%ds", n(1))).when(seconds < 3600, F.format_string("%dm %ds", n(60), n(1) % 60))
        .when(seconds < 86400, F.format_string("%dh %dm", n(3600), n(60) % 60)).otherwise(F.format_string("%dd %dh", n(86400), n(3600) % 24))
    )


def raise_effort(tier: Column, bumps: Column) -> Column:
    """A tier some steps further up a ladder of five; the ends hold."""
    ladder = F.array(*(F.lit(t) for t in EFFORT_LADDER))
    at = F.array_position(ladder, tier).cast("int")
    return F.when(at > 0, F.element_at(ladder, F.greatest(F.lit(1), F.least(F.lit(len(EFFORT_LADDER)), at + bumps)).cast("int")))


def id_type(source: Column) -> Column:
    """channel, playlist, video or unknown, in that order of trial; a video id with the prefix of a playlist is a playlist."""
    return (
        F.when(source.rlike(r"^UC[a-zA-Z0-9_-]{22}$"), "channel").when(source.rlike(r"^(?:PL|UU|FL|OL|LL|WL|HL|RD|EL)"), "playlist")
        .when(source.rlike(r"^[a-zA-Z0-9_-]{11}$"), "video").otherwise("unknown")
    )


def handle_key(handle: Column) -> Column:
    """Handles are equal without @ and case."""
    return F.lower(F.regexp_replace(handle, "^@+", ""))


def detail_level(seconds: Column) -> Column:
    """How detailed a prompt is for a duration: short to ten minutes, long beyond an hour, medium else and where unknown."""
    return F.when(seconds <= 600, "short").when(seconds > 3600, "long").otherwise("medium")


def error_label(kind: Column) -> Column:
    return F.concat(F.lit("error:"), F.coalesce(kind, F.lit("unknown")))


# Statuses of failures that are known; any other is an error.
STATUSES = {
    "VideoUnavailable": "unavailable", "TranscriptsDisabled": "unavailable", "NoTranscriptFound": "unavailable", "CommentsDisabled": "disabled", "PlaylistInaccessible": "inaccessible", "RequestBlocked": "blocked",
}


def status_of(kind: Column) -> Column:
    """The status a failure of a kind leads to; error for any kind that isn't known, and for null."""
    table = F.create_map(*(F.lit(x) for pair in STATUSES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(kind, F.lit(""))), F.lit("error"))


def call_cost(operation: Column, costs: Mapping[str, int]) -> Column:
    """The cost of an operation; 1 if it isn't listed."""
    table = F.create_map(*(F.lit(x) for pair in costs.items() for x in pair)) if costs else F.create_map().cast("map<string,int>")
    return F.coalesce(F.try_element_at(table, operation), F.lit(1)).cast("bigint")


