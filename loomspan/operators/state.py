"""State kept between runs: stamps, layouts, resume tokens, blocked batches, indexes and caches by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamped(meta: DataFrame, stamps: DataFrame, key: str, entries: str = "meta") -> DataFrame:
    """Maps of metadata merged by key: new entries win, the others stay, keys that only one side has stay too. One row a key on either side."""
    new = stamps.select(F.col(key).alias("__k"), F.col(entries).alias("__new"))
    both = meta.select(key, entries).join(new, F.col(key) == F.col("__k"), "full")
    kept = F.map_filter(entries, lambda k, _: ~F.map_contains_key(F.col("__new"), k))
    merged = F.when(F.col("__new").isNull(), F.col(entries)).when(F.col(entries).isNull(), F.col("__new")).otherwise(F.map_concat(kept, F.col("__new")))
    return both.select(F.coalesce(key, "__k").alias(key), merged.alias(entries))


def layout(whole: Column, parts: Column, stamp: Column) -> Column:
    """(state, action) of a stored transcript: flat (one whole text) is to be moved, parts without stamp are to be stamped, current ones stay, others are skipped."""
    state = F.when(parts & stamp, "current").when(parts, "unstamped").when(whole, "flat").otherwise("absent")
    action = F.when(state == "flat", "move").when(state == "unstamped", "stamp").when(state == "current", "none").otherwise("skip")
    return F.struct(state.alias("state"), action.alias("action"))


def stopped_at_block(rows: DataFrame, batch: str, order: str, outcome: str, blocked: str = "blocked") -> DataFrame:
    """``rows`` with tried: whether the batch came to them. A batch ends with its first blocked row; other errors end nothing.

    One aggregate by batch, joined back: no sequence is worked in one task.
    """
    ends = rows.groupBy(batch).agg(F.min(F.when(F.col(outcome) == blocked, F.col(order))).alias("__end"))
    return rows.join(ends, batch).withColumn("tried", F.col("__end").isNull() | (F.col(order) <= F.col("__end"))).drop("__end")


def resumed(pages: DataFrame, state: DataFrame, *, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """One run of a paged fetch: the pages it keeps, and the state it leaves.

    ``pages``: feed, page, ok; ``state``: feed, token (the page to go on from).
    A feed goes on from its token (from the start with ``force``, or without
    token) until a page fails; what came before is kept, and the failed page is the
    new token. A feed that comes to its end has no token and is complete.
    """
    begun = pages.join(state.select("feed", "token"), "feed", "left").withColumn("token", F.lit(0) if force else F.coalesce("token", F.lit(0)))
    ahead = begun.filter(F.col("page") >= F.col("token"))
    ends = ahead.groupBy("feed").agg(F.min(F.when(~F.col("ok"), F.col("page"))).alias("token"))
    kept = ahead.drop("token").join(ends.withColumnRenamed("token", "failed"), "feed").filter(F.col("failed").isNull() | (F.col("page") < F.col("failed"))).select("feed", "page")
    return kept, ends.withColumn("complete", F.col("token").isNull())


def rebuilt_index(index: DataFrame, rows: DataFrame, *, built_with: int, version: int, key: str = "video_id", at: str = "last_updated") -> DataFrame:
    """An index brought up to date with ``rows``: built anew if its version isn't ``version``; else rows of keys that are gone or of another time are replaced.

    Both have ``key``, ``at`` and the same other columns. Keys and times alone are compared.
    """
    if built_with != version:
        return rows.select(*index.columns)
    now = rows.select(key, at).distinct()
    kept = index.join(now, [key, at], "left_semi")
    new = rows.select(*index.columns).join(index.select(key, at).distinct(), [key, at], "left_anti")
    return kept.unionByName(new)


def uncached(rows: DataFrame, cache: DataFrame, keys: list[str], content: str, version: int) -> DataFrame:
    """Rows that a cache (keys, digest, version) doesn't hold for their present content and the present version."""
    known = cache.filter(F.col("version") == version).select(*keys, "digest").distinct()
    return rows.withColumn("digest", F.sha2(F.col(content), 256)).join(known, [*keys, "digest"], "left_anti").drop("digest")


def expanded(tops: DataFrame, there: DataFrame, fetched: DataFrame) -> DataFrame:
    """Threads after their replies were fetched: thread_id, present, complete.

    ``tops``: thread_id, complete; ``there`` and ``fetched``: thread_id,
    comment_id. A reply that is here already counts once; a thread that was
    fetched is complete.
    """
    both = there.select("thread_id", "comment_id").withColumn("new", F.lit(False)).unionByName(fetched.select("thread_id", "comment_id").withColumn("new", F.lit(True)))
    once = both.groupBy("thread_id", "comment_id").agg(F.max("new").alias("new"))
    counts = once.groupBy("thread_id").agg(F.count(F.lit(1)).alias("present"), F.max("new").alias("new"))
    rows = tops.join(counts, "thread_id", "left")
    return rows.select("thread_id", F.coalesce("present", F.lit(0)).alias("present"), (F.coalesce("complete", F.lit(False)) | F.coalesce("new", F.lit(False))).alias("complete"))
