"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.latest import latest_row


def list_hash(items: Column) -> Column:
    """A 128-bit digest of an ordered list; null for a null list, not for an empty one."""
    return F.when(items.isNotNull(), F.md5(F.to_json(F.struct(items.alias("x")))))


def snapshot_changes(
    df: DataFrame,
    *,
    key: str,
    snapshot: str,
    content: str,
    version: str,
) -> DataFrame:
    """Added, removed and changed keys between each delivered snapshot and the one before.

    Each key's rows are put in order of the snapshots' index. A lagged content
    hash tells a change, a gap in the index a removal and a later addition.

    The row with the greatest ``version`` stands for a key within a snapshot
    (null is least; ties go to the greater hash, then a known list). Null
    content says nothing: it neither changes nor forgets the last known list.
    Rows without key or snapshot date are no records and are left out; a date
    counts as delivered if any row carries it. The first snapshot gives no
    rows, an empty table none. Other columns are ignored, whatever their names.

    Returns snapshot (as in the input), key, change ('added', 'removed', 'changed').

    Cost: one shuffle of (key, date, version, digest), not of the content; a
    key repeated within a snapshot is reduced before it. A key has at most one
    row per snapshot afterwards, so no group is larger than the number of dates.
    """
    rows = df.select(
        F.col(snapshot).alias("snap"),
        F.col(key).alias("key"),
        F.col(version).alias("version"),
        list_hash(F.col(content)).alias("digest"),
    ).filter(F.col("snap").isNotNull())
    # One row per delivered date: as many as there are deliveries, never as many as records.
    dates = rows.select("snap").distinct()
    index = dates.select(
        F.col("snap").alias("i_snap"),
        F.row_number().over(Window.orderBy("snap")).alias("idx"),
        F.lead("snap").over(Window.orderBy("snap")).alias("next_snap"),
    )
    one = latest_row(
        rows.filter(F.col("key").isNotNull()),
        ["key", "snap"],
        [F.col("version").desc_nulls_last(), F.col("digest").desc_nulls_last()],
    )
    w = Window.partitionBy("key").orderBy("snap")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = one.join(index, one["snap"] == index["i_snap"]).select(
        "key",
        "snap",
        "idx",
        "next_snap",
        "digest",
        F.lag("idx").over(w).alias("prev_idx"),
        F.lead("idx").over(w).alias("next_idx"),
        F.last("digest", ignorenulls=True).over(before).alias("known"),
    )
    added = (F.col("idx") > 1) & (F.col("prev_idx").isNull() | (F.col("prev_idx") < F.col("idx") - 1))
    changed = (F.col("prev_idx") == F.col("idx") - 1) & (F.col("digest") != F.col("known"))
    removed = F.col("next_snap").isNotNull() & (F.col("next_idx").isNull() | (F.col("next_idx") > F.col("idx") + 1))
    events = F.array_compact(
        F.array(
            F.when(added, F.struct(F.col("snap").alias("at"), F.lit("added").alias("change"))),
            F.when(changed, F.struct(F.col("snap").alias("at"), F.lit("changed").alias("change"))),
            F.when(removed, F.struct(F.col("next_snap").alias("at"), F.lit("removed").alias("change"))),
        )
    )
    return seen.select("key", F.explode(events).alias("e")).select(
        F.col("e.at").alias(snapshot), F.col("key").alias(key), F.col("e.change").alias("change")
    )
