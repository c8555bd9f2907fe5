"""Descriptions split into blocks, and blocks that a channel repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.session import materialize

#: Videos of a channel from which on a block is boilerplate.
REPEATED = 3
#: Version of the rules; what was derived with another is derived anew.
VERSION = 1
SHORT_LINE = 120
HEADER = 60


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?|[\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", "\n"), "\n", -1)


def _opened(lines: Column) -> Column:
    """The two leading lines set apart if both are short: they are what viewers see first."""
    first, second = F.get(lines, 0), F.get(lines, 1)
    short = lambda line: (X.strip(line) != "") & (X.display_length(X.strip(line)) < SHORT_LINE)
    apart = F.concat(F.array(first, F.lit(""), second, F.lit("")), F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))))
    return F.when((F.size(lines) >= 2) & F.coalesce(short(first) & short(second), F.lit(False)), apart).otherwise(lines)


def _sections(lines: Column) -> Column:
    """Runs of lines, each with the separator line above it (null for the first)."""
    at = F.array_compact(F.transform(lines, lambda line, i: F.when((X.strip(line) != "") & X.is_separator(line), i)))

    def cut(begins: Column) -> Column:
        until = lambda k: F.coalesce(F.get(begins, k + 1), F.size(lines))
        return F.transform(begins, lambda i, k: F.struct(F.when(i >= 0, F.get(lines, i)).alias("sep"), F.slice(lines, i + 2, until(k) - i - 1).alias("body")))

    return X.let(F.concat(F.array(F.lit(-1)), at), cut)


def split_blocks(text: Column) -> Column:
    """The blocks of a description, in order.

    Separator lines stand apart, unless they underline a header: one line of at
    most 60 characters above, and more than one or a long line below. Lines of
    hashtags stand apart. The rest is divided at blank lines.
    """
    return X.let(X.let(X.let(_lines(text), _opened), _sections), _joined)


def _joined(sections: Column) -> Column:
    full = lambda s: F.filter(F.transform(s["body"], X.strip), lambda line: line != "")
    apart = lambda line: F.array(F.lit(""), line, F.lit(""))

    def laid_out(s: Column, i: Column) -> Column:
        above, below = full(F.get(sections, i - 1)), full(s)
        underline = (F.size(above) == 1) & (F.length(F.get(above, 0)) <= HEADER) & ((F.size(below) > 1) | F.exists(below, lambda line: F.length(line) > HEADER))
        head = F.when(s["sep"].isNull(), F.array().cast("array<string>")).when(~F.coalesce(underline, F.lit(False)) | X.is_hashtags(s["sep"]), apart(s["sep"])).otherwise(F.array(s["sep"]))
        return F.concat(head, F.flatten(F.transform(s["body"], lambda line: F.when(X.is_hashtags(line), apart(line)).otherwise(F.array(line)))))

    whole = F.array_join(F.flatten(F.transform(sections, laid_out)), "\n")
    return F.filter(F.transform(F.split(whole, "\n\n+", -1), X.strip), lambda b: b != "")


def blocks(videos: DataFrame) -> DataFrame:
    """video_id, channel_id, pos, block, checksum of every block of every description. One row a video is expected."""
    rows = videos.filter(F.col("description").isNotNull()).select("video_id", "channel_id", F.posexplode(split_blocks(F.col("description"))).alias("pos", "block"))
    return rows.withColumn("checksum", F.sha2("block", 256))


def index(rows: DataFrame) -> DataFrame:
    """Each checksum once a video."""
    return rows.filter(F.col("channel_id").isNotNull()).select("channel_id", "checksum", "video_id").distinct()


def frequencies(rows: DataFrame) -> DataFrame:
    """How many videos of a channel hold a block."""
    return index(rows).groupBy("channel_id", "checksum").agg(F.count(F.lit(1)).alias("videos"))


def _with_frequency(rows: DataFrame) -> DataFrame:
    return rows.join(frequencies(rows), ["channel_id", "checksum"], "left").withColumn("repeated", F.coalesce(F.col("videos") >= REPEATED, F.lit(False)))


def _reassembled(kept: DataFrame) -> DataFrame:
    """The kept blocks of a video in order; no group is larger than a description."""
    return kept.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "block"))), lambda b: b["block"]).alias("kept"))


def strip_boilerplate(videos: DataFrame) -> DataFrame:
    """Descriptions without blocks of links or hashtags that a channel repeats.

    Prose stays, and so do blocks with times. Of adjacent separators the first
    stays, and none at either end. Videos without channel keep all; null stays null.
    """
    rows = _with_frequency(materialize(blocks(videos)))
    b = F.col("block")
    keep = ~X.has_link(b) & ~X.is_hashtags(b) | X.has_line_time(b) | ~F.col("repeated")
    merged = _reassembled(rows.filter(keep))
    once = F.filter("kept", lambda x, i: ~X.is_separator(x) | ~F.coalesce(X.is_separator(F.get(F.col("kept"), i - 1)), F.lit(False)))
    edges = F.filter(F.col("once"), lambda x, i: ~X.is_separator(x) | (i > 0) & (i < F.size("once") - 1))
    clean = merged.withColumn("once", once).select("video_id", F.array_join(edges, "\n\n").alias("stripped"))
    return videos.select("video_id", "description").join(clean, "video_id", "left").select("video_id", F.when(F.col("description").isNotNull(), F.coalesce("stripped", F.lit(""))).alias("description"))


def narrow(videos: DataFrame) -> DataFrame:
    """Blocks without their text: video_id, channel_id, checksum, whether it is a separator, and its length; written once."""
    b = F.col("block")
    return materialize(blocks(videos).select("video_id", "channel_id", "checksum", X.is_separator(b).alias("separator"), F.length(b).cast("bigint").alias("length")))


def unique_length(videos: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The length of what a description alone says: without separators and without any repeated block. ``rows``: narrow(videos), if it is at hand."""
    own = _with_frequency(narrow(videos) if rows is None else rows).filter(~F.col("repeated") & ~F.col("separator"))
    sizes = own.groupBy("video_id").agg((F.sum("length") + F.count(F.lit(1)) - 1).alias("n"))  # blocks hold no blank lines; a line feed joins two
    return videos.select("video_id", "channel_id").join(sizes, "video_id", "left").select("video_id", "channel_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("unique_length"))


def channel_stats(videos: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """By channel: videos, rows of the index, checksums, and rows whose checksum is repeated. ``rows``: narrow(videos), if it is at hand."""
    rows = narrow(videos) if rows is None else rows
    per = frequencies(rows)
    sums = per.groupBy("channel_id").agg(F.sum("videos").alias("rows"), F.count(F.lit(1)).alias("checksums"), F.sum(F.when(F.col("videos") >= REPEATED, F.col("videos")).otherwise(0)).alias("repeated_rows"))
    counts = rows.filter(F.col("channel_id").isNotNull()).select("channel_id", "video_id").distinct().groupBy("channel_id").agg(F.count(F.lit(1)).alias("videos"))
    return counts.join(sums, "channel_id")


def grand_totals(videos: DataFrame) -> DataFrame:
    """The mean unique length over all videos (channels weighed by their videos) and the share of repeated rows. Descriptions are split once."""
    rows = narrow(videos)
    lengths = unique_length(videos, rows).filter(F.col("channel_id").isNotNull()).groupBy("channel_id").agg(F.avg("unique_length").alias("mean"), F.count(F.lit(1)).alias("n"))
    share = channel_stats(videos, rows).agg(F.sum("rows").alias("rows"), F.sum("repeated_rows").alias("repeated_rows"))
    means = lengths.agg(F.sum(F.col("mean") * F.col("n")).alias("w"), F.sum("n").alias("videos"))
    both = means.unionByName(share, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("w", "videos", "rows", "repeated_rows")))  # two rows
    return both.select("videos", F.round(F.col("w") / F.col("videos"), 4).alias("mean_unique_length"), F.round(100 * F.col("repeated_rows") / F.col("rows"), 4).alias("boilerplate_percent"))


def clean_tags(tags: Column, title: Column) -> Column:
    """Tags that neither hold the channel's title nor are held by it, whatever the case."""
    name = F.lower(F.coalesce(title, F.lit("")))
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~F.contains(name, F.lower(t)) & ~F.contains(F.lower(t), name))
