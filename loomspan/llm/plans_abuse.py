"""Queries of the problem of abusive, hateful and sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.abuse import MAX_LABELS, fit_weights, rates, score_texts
from loomspan.llm.threads import latest_comments
from loomspan.operators.latest import latest_row
from loomspan.sources.tables import table


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    comments = latest_comments(table(spark, folder, "comments"), "text_original", "video_id")
    labels = table(spark, folder, "comment_labels").select("text_original", "abusive", "hateful", "sexual").limit(MAX_LABELS).collect()
    return score_texts(comments, text="text_original", weights=fit_weights(labels)).drop("text_original", "last_seen")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Comments with abusive, hateful or sexual content."""
    return _scored(spark, folder).filter("found").select("comment_id")


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores and the verdict of every comment."""
    return _scored(spark, folder)


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Comments, found comments and rates of every video and every channel."""
    by_video = rates(_scored(spark, folder), "video_id")
    owners = latest_row(
        table(spark, folder, "videos").filter(F.col("video_id").isNotNull()).select("video_id", "channel_id", "last_updated"),
        ["video_id"], [F.col("last_updated").desc_nulls_last(), F.col("channel_id").desc_nulls_last()],
    ).select("video_id", "channel_id")
    with_channel = by_video.join(owners, "video_id", "left")
    sums = ["texts", "found_texts", "abusive_texts", "hateful_texts", "sexual_texts"]
    by_channel = with_channel.groupBy("channel_id").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("rate", F.col("found_texts") / F.col("texts"))
    columns = [*sums, "rate"]
    return by_video.select(F.lit("video").alias("source"), F.col("video_id").alias("source_id"), *columns).unionByName(
        by_channel.select(F.lit("channel").alias("source"), F.col("channel_id").alias("source_id"), *columns)
    )


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_rates": p1_rates}
ORACLE: dict[str, str] = {}
