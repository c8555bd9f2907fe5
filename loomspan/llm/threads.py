"""Conversations rebuilt from messages that are stored as single rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.latest import latest_row
from loomspan.session import materialize

#: Messages of one conversation that a task holds before it hands them on as a piece.
HELD = 100_000


class ThreadAutomaton:
    """Which sequences of messages make a usable conversation.

    Messages are read in order of time, then id. The role of a message in its
    thread is to open it (TOP) or to answer (ANSWER); other symbols are flaws:
    UNDATED, EMPTY, STRAY (of another video than the top), EARLY (before what it
    answers). States: START; BEFORE, where answers of the opener's own instant
    have been read whose ids are less; OPEN; ANSWERED; BROKEN, which is never left. A second
    opener and every flaw break a conversation. A run over a piece is the array
    of the states it leads to from each state; runs over pieces are composed in order.
    """

    TOP, ANSWER, UNDATED, EMPTY, STRAY, EARLY = range(6)
    START, BEFORE, OPEN, ANSWERED, BROKEN = range(5)
    NEXT = np.full((6, 5), BROKEN)
    NEXT[TOP, [START, BEFORE]] = OPEN, ANSWERED
    NEXT[ANSWER, [START, BEFORE, OPEN, ANSWERED]] = BEFORE, BEFORE, ANSWERED, ANSWERED
    STEPS = [tuple(row) for row in NEXT.tolist()]

    @classmethod
    def symbol(cls, top: Column, undated: Column, empty: Column, stray: Column, early: Column) -> Column:
        flaws = F.when(undated, cls.UNDATED).when(empty, cls.EMPTY).when(stray, cls.STRAY).when(early, cls.EARLY)
        return flaws.otherwise(F.when(top, cls.TOP).otherwise(cls.ANSWER)).cast("int")

    @classmethod
    def compose(cls, maps: Column) -> Column:
        """The end state of runs over the pieces of a conversation, in order."""
        return F.aggregate(maps, F.lit(cls.START), lambda state, run: F.element_at(run, state + 1))


def _run(held: int):
    """Sorted messages become numbered ones: of accepted conversations, and pieces of those that may go on in other tasks.

    Rows without comment_id sum a piece up: its run and its messages; the first
    and the last conversation of a task, and pieces of ``held`` messages, are left open.
    """
    columns = ["thread_id", "piece", "msg_no", "comment_id", "run", "wanted"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        thread, ids, states, wanted, piece, first, number = None, [], (0, 1, 2, 3, 4), 0, 0, True, 0
        steps = ThreadAutomaton.STEPS

        def close(open_: bool) -> None:
            if open_ or piece:
                out.extend((thread, number, n, c, None, None) for n, c in enumerate(ids))
                out.append((thread, number, len(ids), None, list(states), wanted))
            elif states[0] == ThreadAutomaton.ANSWERED and len(ids) > wanted:
                out.extend((thread, None, n, c, None, None) for n, c in enumerate(ids))

        for pdf in batches:
            for t, c, symbol, want, part in zip(*(pdf[k].tolist() for k in ("thread_id", "comment_id", "symbol", "wanted", "part"))):
                if t != thread or len(ids) >= held:
                    if ids:
                        close(first or t == thread)
                    if t != thread:
                        first, piece = first and thread is None, 0
                    else:
                        piece += 1
                    thread, ids, states, wanted, number = t, [], (0, 1, 2, 3, 4), 0, (part << 32) + piece
                ids.append(c)
                step = steps[symbol]
                states = tuple([step[s] for s in states])
                wanted = max(wanted, int(want))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=columns).astype({"piece": "Int64", "wanted": "Int64"})
                out.clear()
        if ids:
            close(True)
        yield pd.DataFrame(out, columns=columns).astype({"piece": "Int64", "wanted": "Int64"})

    return run


def visible(text: Column) -> Column:
    """Holds a character that isn't whitespace, a control, a format or a filler character; false for null."""
    return F.coalesce(text.rlike(r"(?U)[^\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}\x{FE00}-\x{FE0F}]"), F.lit(False))


def latest_comments(comments: DataFrame, *columns: str) -> DataFrame:
    """The fetch of each comment with the greatest last_seen; ties go to the greatest of the other columns."""
    keep = list(dict.fromkeys(("comment_id", "last_seen", *columns)))
    order = [F.col(c).desc_nulls_last() for c in keep if c != "comment_id"]
    return latest_row(comments.filter(F.col("comment_id").isNotNull()).select(*keep), ["comment_id"], order)


def _with_parents(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Top messages, and answers whose parent exists with their parent's parent; all with their symbols."""
    parent = F.when(F.col("parent_id").rlike(r"(?U)[^\s]"), F.col("parent_id"))
    slim = comments.select(
        "comment_id", "video_id", "published_at", F.col("total_reply_count").cast("long").alias("total_reply_count"), "last_seen",
        parent.alias("parent_id"), visible(F.col("text_original")).alias("visible"),
    )
    one = materialize(latest_comments(slim, "video_id", "published_at", "total_reply_count", "parent_id", "visible"))
    undated, empty = F.col("published_at").isNull(), ~F.col("visible")
    tops = one.filter(F.col("parent_id").isNull())
    tops = tops.select(
        "comment_id", "published_at", F.greatest(F.coalesce("total_reply_count", F.lit(0)), F.lit(0)).alias("wanted"),
        ThreadAutomaton.symbol(F.lit(True), undated, empty, F.lit(False), F.lit(False)).alias("symbol"),
    )
    above = one.select(F.col("comment_id").alias("parent_id"), F.col("parent_id").alias("grandparent"), F.col("video_id").alias("a_video"), F.col("published_at").alias("a_at"))
    stray = F.coalesce(F.col("video_id") != F.col("a_video"), F.lit(True))
    early = F.coalesce(F.col("published_at") < F.col("a_at"), F.lit(False))
    symbol = ThreadAutomaton.symbol(F.lit(False), undated, empty, stray, early)
    answers = one.filter(F.col("parent_id").isNotNull()).join(above, "parent_id")
    return tops, answers.select("comment_id", "parent_id", "grandparent", "published_at", symbol.alias("symbol"))


def _roots(deep: DataFrame) -> DataFrame:
    """The top message above each answer to an answer, by pointer doubling.

    After n rounds every answer up to 2^n levels deep has its top. The rounds
    end when one settles nothing more: what is left hangs on a circle. Only
    answers to answers take part; each round is checkpointed.
    """
    up = deep.select(F.col("comment_id").alias("u_id"), F.lit(True).alias("u"))
    state = deep.join(up, deep["parent_id"] == up["u_id"], "left").select(
        "comment_id", F.col("parent_id").alias("ptr"), F.when(F.col("u").isNull(), F.col("grandparent")).alias("root")
    )
    state, left = materialize(state), None
    while True:
        now = state.filter(F.col("root").isNull()).count()
        if not now or now == left:
            return state.filter(F.col("root").isNotNull()).select("comment_id", "root")
        left = now
        step = state.select(F.col("comment_id").alias("s_id"), F.col("ptr").alias("s_ptr"), F.col("root").alias("s_root"))
        open_ = state.filter(F.col("root").isNull()).join(step, F.col("ptr") == F.col("s_id")).select("comment_id", F.col("s_ptr").alias("ptr"), F.col("s_root").alias("root"))
        state = materialize(state.filter(F.col("root").isNotNull()).unionByName(open_))


def conversations(comments: DataFrame, *, held: int = HELD) -> DataFrame:
    """The messages of every usable conversation: thread_id, msg_no, comment_id.

    A conversation is a comment without parent and all that answers it, directly
    or through other answers; it is keyed by its top comment. Messages are
    numbered from 0 by published_at, then comment_id. ThreadAutomaton reads them
    in this order and says which conversations are usable: opened once, at least
    one answer, as many as the top's total_reply_count, and no message undated,
    empty, of another video or before what it answers.

    Rows without comment_id are left out; of several fetches the latest counts;
    null or blank parent_id makes a top; answers whose parent is missing, or
    that hang on a circle, belong to no conversation; a null video_id is a flaw
    in an answer. Texts are only looked at, however long; no tables, no rows.

    Cost: one shuffle of narrow rows by comment, one of answers by parent, a
    few of the answers to answers, and one secondary sort: ranges of (thread,
    time, id), so that a hot conversation spreads over as many tasks as it
    needs. Only conversations at the edges of tasks, and those of more than
    ``held`` messages, are settled afterwards, from a row for each of their pieces.
    """
    tops, answers = _with_parents(comments)
    answers = materialize(answers)
    deep = answers.filter(F.col("grandparent").isNotNull())
    columns = ["thread_id", "published_at", "comment_id", "symbol", "wanted"]
    threaded = tops.withColumn("thread_id", F.col("comment_id")).select(*columns)
    none = F.lit(0).cast("long").alias("wanted")
    flat = answers.filter(F.col("grandparent").isNull()).select(F.col("parent_id").alias("thread_id"), "published_at", "comment_id", "symbol", none)
    deeper = deep.join(_roots(deep.select("comment_id", "parent_id", "grandparent")).withColumnRenamed("root", "thread_id"), "comment_id").withColumn("wanted", none).select(*columns)
    order = ["thread_id", "published_at", "comment_id"]
    ordered = threaded.unionByName(flat).unionByName(deeper).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = dict(comments.dtypes)["comment_id"]
    read = ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInPandas(_run(held), f"thread_id {kind}, piece long, msg_no int, comment_id {kind}, run array<int>, wanted long")
    read = materialize(read)
    settled = read.filter(F.col("piece").isNull()).select("thread_id", "msg_no", "comment_id")
    # A row for each task's first and last conversation, and for each ``held`` messages of one conversation.
    pieces = read.filter(F.col("run").isNotNull()).groupBy("thread_id").agg(
        F.sort_array(F.collect_list(F.struct("piece", F.col("msg_no").alias("n"), "run"))).alias("pieces"), F.sum("msg_no").alias("n"), F.max("wanted").alias("wanted")
    )
    usable = pieces.filter((ThreadAutomaton.compose(F.col("pieces.run")) == ThreadAutomaton.ANSWERED) & (F.col("n") > F.col("wanted")))
    before = F.transform("pieces", lambda p, i: F.struct(p["piece"].alias("piece"), F.aggregate(F.slice("pieces", 1, i), F.lit(0).cast("long"), lambda n, q: n + q["n"]).alias("offset")))
    offsets = usable.select("thread_id", F.inline(before))
    open_ = read.filter(F.col("piece").isNotNull() & F.col("comment_id").isNotNull()).join(offsets, ["thread_id", "piece"])
    return settled.unionByName(open_.select("thread_id", (F.col("msg_no") + F.col("offset")).cast("int").alias("msg_no"), "comment_id"))


def with_roles(numbered: DataFrame, comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Each message of ``conversations`` with its text and its author's role.

    Roles: 'owner' (the channel that owns the video; the latest row of the
    video counts), 'starter' (the author of the top comment), 'other' (anybody
    else, and messages without author). Returns thread_id, msg_no, comment_id,
    video_id, role, text.
    """
    said = latest_comments(comments.select("comment_id", "last_seen", "video_id", "author_channel_id", "text_original"), "video_id", "author_channel_id", "text_original")
    owner = latest_row(
        videos.filter(F.col("video_id").isNotNull()).select("video_id", "channel_id", "last_updated"),
        ["video_id"], [F.col("last_updated").desc_nulls_last(), F.col("channel_id").desc_nulls_last()],
    ).select(F.col("video_id").alias("o_video"), F.col("channel_id").alias("owner"))
    rows = numbered.join(said.drop("last_seen"), "comment_id")
    top = said.select(F.col("comment_id").alias("t_thread"), F.col("author_channel_id").alias("starter"))
    rows = rows.join(top, rows["thread_id"] == top["t_thread"]).join(owner, rows["video_id"] == owner["o_video"], "left")
    author = F.col("author_channel_id")
    role = F.when(author == F.col("owner"), "owner").when(author == F.col("starter"), "starter").otherwise("other")
    return rows.select("thread_id", "msg_no", "comment_id", "video_id", role.alias("role"), F.col("text_original").alias("text"))
