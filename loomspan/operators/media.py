"""Pointers to media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def probe(streams: Column) -> Column:
    """The first video and the first audio stream of a probed file."""
    first = lambda kind: F.get(F.filter(streams, lambda s: s["codec_type"] == kind), 0)
    v, a = first("video"), first("audio")
    return F.struct(
        v.isNotNull().alias("has_video"), v["codec_name"].alias("video_codec"), v["width"].alias("width"), v["height"].alias("height"),
        a.isNotNull().alias("has_audio"), a["codec_name"].alias("audio_codec"), a["channels"].alias("channels"),
    )


def distinct_pointers(df: DataFrame, key: str) -> DataFrame:
    """Pointers once a path, the first added; the first of each key is the one to probe."""
    once = Window.partitionBy(key, "path").orderBy("added")
    rows = df.withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n")
    return rows.withColumn("to_probe", F.row_number().over(Window.partitionBy(key).orderBy("added", "path")) == 1)


def usable_pointer(df: DataFrame, key: str, *, video: bool, audio: bool) -> DataFrame:
    """The first pointer of each key that exists and has what is needed; what isn't known is taken to be there."""
    fits = F.col("exists") & (F.lit(not video) | F.coalesce("has_video", F.lit(True))) & (F.lit(not audio) | F.coalesce("has_audio", F.lit(True)))
    first = Window.partitionBy(key).orderBy("added", "path")
    return df.filter(fits).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def found_by(*sources: tuple[str, Column]) -> Column:
    """The first source in order that has a path: (found_via, path)."""
    return F.coalesce(*(F.when(path.isNotNull(), F.struct(F.lit(name).alias("found_via"), path.alias("path"))) for name, path in sources))


def significant_colors(counts: Column) -> Column:
    """How many colours of a palette cover more than a twentieth of the image."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    return F.size(F.filter(counts, lambda c: c > 0.05 * total))
