"""The row that stands for a key among several fetches of it, and keys that hold very many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANK = "__rank"


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``.

    The filter on the row number lets Spark keep one row per key and map task
    before the shuffle, so a key repeated many times costs no more than others.
    Rows with a null key form a group of their own, an empty table gives an
    empty one; give an order that leaves no ties between different rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(RANK, F.row_number().over(w)).filter(F.col(RANK) == 1).drop(RANK)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; counted with map-side combining.

    At most (rows / limit) keys can come out.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).drop("__n")
