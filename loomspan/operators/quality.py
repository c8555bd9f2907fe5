"""Comments scored for quality from their text, their author and the thread around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import text as X
from loomspan.functions.values import handle_key, to_int
from loomspan.operators.latest import latest_row
from loomspan.session import materialize

GATE_LENGTH = 200
QUALITY_SCORE = 5.0
EXPAND_SCORE = 10.0
RELEVANCE_MOST = 6.0
ENTITY_LENGTH = 30
FETCH_LENGTH = 50
#: Positions in a block when rows of one group are numbered.
BLOCK = 100_000


def numbered(df: DataFrame, group: str, position: str, tie: str, block: int = BLOCK) -> DataFrame:
    """``df`` with rank (from 0, by position then tie) and size within its group.

    Rows are numbered within blocks of positions, and a table of counts, a row
    a block, gives each block its offset; so a group of any size is spread over
    tasks. Null positions come first.
    """
    at = F.coalesce(F.floor(F.col(position) / block), F.lit(-(2**40)))
    rows = df.withColumn("__block", at)
    counts = rows.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    per = Window.partitionBy(group)
    past = per.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.select(group, "__block", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"), F.sum("__n").over(per).alias("size"))
    own = Window.partitionBy(group, "__block").orderBy(F.col(position).asc_nulls_first(), F.col(tie))
    both = rows.withColumn("__i", F.row_number().over(own) - 1).join(sizes, [group, "__block"])
    return both.withColumn("rank", F.col("__before") + F.col("__i")).drop("__block", "__i", "__before")


def current_comments(comments: DataFrame, *, with_text: bool = True) -> DataFrame:
    """The latest fetch of each comment; blank parents are none. Ties go by a hash of the text.

    What thread facts need of a text (text_length, mention) is read before the
    shuffle, so without the text itself only narrow rows are moved.
    """
    keep = ["video_id", "parent_id", "author_channel_id", "like_count", "published_at", "updated_at", "total_reply_count", "replies_complete", "ordinal"]
    t = F.coalesce("text_original", F.lit(""))
    rows = comments.filter(F.col("comment_id").isNotNull()).select("comment_id", "last_seen", *keep, F.length(t).alias("text_length"), X.is_mention(t).alias("mention"), F.xxhash64(t).alias("hash"), *([t.alias("text")] if with_text else []))
    one = latest_row(rows, ["comment_id"], [F.col(c).desc_nulls_last() for c in ("last_seen", "hash", *keep)])
    return one.withColumn("parent_id", F.when(~X.is_blank(F.col("parent_id")), F.col("parent_id"))).drop("last_seen", "hash")


def current_channels(channels: DataFrame) -> DataFrame:
    return latest_row(channels.filter(F.col("channel_id").isNotNull()), ["channel_id"], [F.col("last_updated").desc_nulls_last(), F.col("received_at").desc_nulls_last()])


def owners(videos: DataFrame) -> DataFrame:
    rows = videos.filter(F.col("video_id").isNotNull()).select("video_id", F.col("channel_id").alias("creator_id"), "last_updated")
    return latest_row(rows, ["video_id"], [F.col("last_updated").desc_nulls_last(), F.col("creator_id").desc_nulls_last()]).drop("last_updated")


def author_tier(comments: DataFrame, subscriptions: DataFrame, channels: DataFrame) -> DataFrame:
    """author_tier of rows with author_channel_id and creator_id: creator, subscribed, known or unknown, the first that holds; unknown without author.

    The two lists are keys only, each once; AQE broadcasts them while they are small.
    """
    subscribed = subscriptions.select(F.col("channel_id").alias("s_id")).filter(F.col("s_id").isNotNull()).distinct()
    known = channels.select(F.col("channel_id").alias("k_id")).filter(F.col("k_id").isNotNull()).distinct()
    both = comments.join(subscribed, comments["author_channel_id"] == F.col("s_id"), "left").join(known, comments["author_channel_id"] == F.col("k_id"), "left")
    tier = F.when(F.col("author_channel_id") == F.col("creator_id"), "creator").when(F.col("s_id").isNotNull(), "subscribed").when(F.col("k_id").isNotNull(), "known").otherwise("unknown")
    return both.withColumn("author_tier", tier).drop("s_id", "k_id")


def shown(*, replies: bool) -> Column:
    """Whether a comment is listed: replies only if asked for, but those of creators and followed channels always. Needs parent_id and author_tier."""
    return F.lit(replies) | F.col("parent_id").isNull() | F.col("author_tier").isin("creator", "subscribed")


def author_points(channels: DataFrame, clock: str) -> DataFrame:
    """channel_id and the points of each mark of its owner: handle, name, age, subscribers, activity.

    ``channels``: one row a channel. A column distinct_colors, if there is one, adds the mark of a default avatar.
    """
    handle, title = handle_key(F.coalesce("custom_url", F.lit(""))), F.lower(X.strip(F.coalesce("title", F.lit(""))))
    active = (F.coalesce(to_int(F.col("uploads_count")), F.lit(0)) >= 1) | (F.coalesce(F.size("playlists_data"), F.lit(0)) > 0)
    days = F.expr(f"timestampdiff(SECOND, published_at, TIMESTAMP_NTZ'{clock}')") / 86400
    avatar = F.col("distinct_colors") <= 2 if "distinct_colors" in channels.columns else F.lit(False)
    points = {
        "handle_botlike": F.greatest(F.lit(-10), -3 * F.size(X.botlike_reasons(handle))),
        "handle_eq_name": F.when(~active & (handle != "") & (handle == title), -8).otherwise(0),
        "default_avatar": F.when(~active & F.coalesce(avatar, F.lit(False)), -5).otherwise(0),
        "age_5y": F.when(days >= 5 * 365, 3).otherwise(0),
        "subs_20": F.when(to_int(F.col("subscriber_count")) >= 20, 3).otherwise(0),
        "active": F.when(active, 2).otherwise(0),
    }
    return channels.select("channel_id", *(F.coalesce(p, F.lit(0)).cast("double").alias(k) for k, p in points.items()))


def creator_replies(comments: DataFrame) -> DataFrame:
    """The length of the creator's longest reply to each parent, from rows with creator_id."""
    mine = comments.filter(F.col("parent_id").isNotNull() & (F.col("author_channel_id") == F.col("creator_id")))
    return mine.groupBy("parent_id").agg(F.max("text_length").cast("bigint").alias("reply_length"))


def mentioned_parents(comments: DataFrame) -> DataFrame:
    """Parents with a reply that begins with a mention."""
    return comments.filter(F.col("parent_id").isNotNull() & F.col("mention")).select("parent_id").distinct()


def relevance(comments: DataFrame) -> DataFrame:
    """Points of the first third of a video's top comments, falling from the first on."""
    top = numbered(comments.filter(F.col("parent_id").isNull()).select("comment_id", "video_id", "ordinal"), "video_id", "ordinal", "comment_id")
    cutoff = F.greatest(F.lit(1), F.floor(F.col("size") / 3))
    points = F.bround(RELEVANCE_MOST * (1 - F.col("rank") / cutoff), 1)
    return top.filter(F.col("rank") < cutoff).select("comment_id", "video_id", "rank", "size", points.alias("points")).filter(F.col("points") > 0)


def thread_gaps(comments: DataFrame) -> DataFrame:
    """By video: threads, threads with fewer replies than they report, what they report, and what is missing. Replies are counted in threads with gaps alone."""
    there = comments.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("p_id")).agg(F.count(F.lit(1)).alias("present"))
    top = comments.filter(F.col("parent_id").isNull() & (F.coalesce("total_reply_count", F.lit(0)) > 0)).select("comment_id", "video_id", "total_reply_count")
    both = top.join(there, top["comment_id"] == there["p_id"], "left").withColumn("present", F.coalesce("present", F.lit(0)))
    gap = F.col("total_reply_count") > F.col("present")
    total = lambda c: F.coalesce(F.sum(F.when(gap, c)), F.lit(0)).cast("bigint")
    return both.groupBy("video_id").agg(F.count(F.lit(1)).alias("threads"), F.count_if(gap).alias("threads_with_gaps"), total(F.col("total_reply_count")).alias("replies_reported"), total(F.col("total_reply_count") - F.col("present")).alias("replies_missing"))


def _thread_facts(now: DataFrame) -> DataFrame:
    """What the thread says of a comment, in one row each: reply_length, mentioned, relevance_points. Combined before the shuffle."""
    mine = F.col("author_channel_id") == F.col("creator_id")
    below = now.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.max(F.when(mine, F.col("text_length"))).alias("reply_length"), F.bool_or("mention").alias("mentioned"))
    below = below.filter(F.col("reply_length").isNotNull() | F.col("mentioned")).withColumnRenamed("parent_id", "comment_id")
    among = relevance(now).select("comment_id", F.col("points").alias("relevance_points"))
    both = below.unionByName(among, allowMissingColumns=True)
    return both.groupBy("comment_id").agg(F.max("reply_length").alias("reply_length"), F.max("mentioned").alias("mentioned"), F.max("relevance_points").alias("relevance_points"))


def _author_facts(known: DataFrame, subscriptions: DataFrame, clock: str) -> DataFrame:
    """What is known of an author, in one row each: followed, here (has a channel here), and the points of the channel's owner."""
    points = author_points(known, clock).withColumnRenamed("channel_id", "a_id").withColumn("here", F.lit(True))
    followed = subscriptions.select(F.col("channel_id").alias("a_id")).filter(F.col("a_id").isNotNull()).distinct().withColumn("followed", F.lit(True))
    return points.join(followed, "a_id", "full")


def _signals(t: Column) -> dict[str, Column]:
    """Points by signal of rows that have the thread's and the author's columns."""
    sentences, technical = X.sentence_count(t), F.col("technical")
    reply = F.coalesce("reply_length", F.lit(0))
    when = lambda c, p: F.when(F.coalesce(c, F.lit(False)), float(p)).otherwise(0.0)
    return {
        "subscribed": when(F.col("author_tier") == "subscribed", 100),
        "citation": when(X.has_citation(t), 5),
        "effort": X.effort_points(F.length(t)),
        "sentences": X.sentence_bonus(sentences),
        **{k: technical[k] for k in X.TECHNICAL},
        "mid_caps": X.caps_step(X.mid_sentence_caps_ratio(t)),
        "replies": when(F.col("total_reply_count") >= 1, 2),
        "reply_chain": when(F.col("mentioned"), 2),
        "likes": when(F.col("like_count") > 0, 1),
        "edited": when(F.col("published_at") != F.col("updated_at"), 1),
        "creator_replied": when(reply > 0, 1),
        "creator_reply_200": when(reply > 200, 1),
        "creator_reply_400": when(reply > 400, 1),
        "creator_reply_600": when(reply > 600, 1),
        "creator_liked": F.lit(0.0),
        "relevance": F.coalesce("relevance_points", F.lit(0.0)),
        **{f"author_{k}": F.coalesce(k, F.lit(0.0)) for k in ("handle_botlike", "handle_eq_name", "default_avatar", "age_5y", "subs_20", "active")},
    }


def classify(comments: DataFrame, videos: DataFrame, channels: DataFrame, subscriptions: DataFrame, *, clock: str, only: DataFrame | None = None) -> DataFrame:
    """quality_class (quality, anti, ignorable), score, author_tier and breakdown of every comment.

    An anti comment scores 0. Quality needs the gate (a trusted author, some
    length, a name or a citation) and the score. Everything is a built-in
    expression. The texts are shuffled once; the thread's facts come from narrow
    rows that are kept meanwhile, and are aggregated before they are joined.
    Null texts are empty, null authors unknown, null counts none. With ``only``
    (comment_id) just these comments are scored, from the facts of all: a second pass.
    """
    owner = owners(videos)
    now = materialize(current_comments(comments, with_text=False).join(owner, "video_id", "left"))
    known = current_channels(channels)
    scored = comments if only is None else comments.join(only.select("comment_id").distinct(), "comment_id", "left_semi")
    rows = current_comments(scored).join(owner, "video_id", "left").join(_thread_facts(now), "comment_id", "left")
    rows = rows.join(_author_facts(known, subscriptions, clock), F.col("author_channel_id") == F.col("a_id"), "left")
    tier = F.when(F.col("author_channel_id") == F.col("creator_id"), "creator").when(F.col("followed"), "subscribed").when(F.col("here"), "known").otherwise("unknown")
    rows = rows.withColumn("author_tier", tier)
    t = F.col("text")
    trusted = F.col("author_tier").isin("creator", "subscribed")
    gate = trusted | (F.length(t) >= GATE_LENGTH) | (F.length(t) >= ENTITY_LENGTH) & (F.size(X.entities(t)) > 0) | X.has_citation(t)
    parts = [F.struct(F.lit(k).alias("signal"), p.alias("points")) for k, p in _signals(t).items()]
    rows = rows.withColumn("anti", X.is_anti(t)).withColumn("gate", gate).withColumn("technical", X.technicality(t))
    rows = rows.withColumn("breakdown", F.when(F.col("anti"), F.array().cast("array<struct<signal:string,points:double>>")).otherwise(F.filter(F.array(*parts), lambda s: s["points"] != 0)))
    rows = rows.withColumn("score", F.round(F.aggregate("breakdown", F.lit(0.0), lambda a, s: a + s["points"]), 1))
    klass = F.when(F.col("anti"), "anti").when(F.col("gate") & (F.col("score") >= QUALITY_SCORE), "quality").otherwise("ignorable")
    return rows.select("comment_id", "video_id", "parent_id", "author_channel_id", "creator_id", "author_tier", klass.alias("quality_class"), "score", "breakdown", "total_reply_count", "replies_complete", "text", "published_at")


def to_expand(classified: DataFrame) -> DataFrame:
    """Top comments good enough for a second pass whose replies aren't all here; they and their replies are scored again once fetched."""
    there = classified.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("p_id")).agg(F.count(F.lit(1)).alias("present"))
    top = classified.filter(F.col("parent_id").isNull() & (F.col("score") >= EXPAND_SCORE) & ~F.coalesce("replies_complete", F.lit(False)))
    both = top.join(there, top["comment_id"] == there["p_id"], "left")
    return both.filter(F.coalesce("total_reply_count", F.lit(0)) > F.coalesce("present", F.lit(0))).select("comment_id", "video_id", "score")


def to_fetch(rows: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Authors worth fetching: of a text of some length, known by id, neither creator nor subscribed."""
    some = rows.filter((F.col("text_length") >= FETCH_LENGTH) & F.col("author_channel_id").isNotNull() & ~F.col("author_channel_id").eqNullSafe(F.col("creator_id")))
    return some.select("author_channel_id").distinct().join(subscriptions.select(F.col("channel_id").alias("author_channel_id")).distinct(), "author_channel_id", "left_anti")


def rendered(comments: DataFrame) -> DataFrame:
    """Each comment as text under its thread, with the keys that order them: thread's time, thread, reply or not, time."""
    now = comments.select("comment_id", "video_id", "parent_id", "text", "published_at", "like_count", "total_reply_count")
    tops = now.filter(F.col("parent_id").isNull()).select(F.col("comment_id").alias("thread_id"), F.col("published_at").alias("thread_at"))
    there = now.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("p_id")).agg(F.count(F.lit(1)).alias("present"))
    rows = now.withColumn("thread_id", F.coalesce("parent_id", "comment_id")).join(tops, "thread_id").join(there, F.col("comment_id") == F.col("p_id"), "left")
    reply = F.col("parent_id").isNotNull()
    indent = F.when(reply, "  ").otherwise("")
    count = F.when(~reply & (F.coalesce("total_reply_count", F.lit(0)) > 0), F.concat(F.lit(" | replies: "), F.coalesce("present", F.lit(0)).cast("string"), F.lit("/"), F.col("total_reply_count").cast("string"))).otherwise("")
    head = F.concat(indent, F.lit("["), "comment_id", F.lit("] likes: "), F.coalesce("like_count", F.lit(0)).cast("string"), count)
    body = F.when(reply, F.regexp_replace(F.concat(F.lit("\n"), "text"), "\n", "\n  ")).otherwise(F.concat(F.lit("\n"), "text"))
    return rows.select("video_id", "thread_at", "thread_id", reply.alias("is_reply"), "published_at", "comment_id", F.concat(head, body).alias("rendered"))
