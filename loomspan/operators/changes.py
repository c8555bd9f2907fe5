"""Change capture, versions, archives and incremental refresh."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def content_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """A digest of columns by name; the order of arrays and of the keys of maps doesn't matter, wherever they are nested."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.md5(F.to_json(F.struct(*(_settled(F.col(c), kinds[c]).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}))


def _settled(value: Column, kind: T.DataType) -> Column:
    """A value with its arrays sorted, those within others too, and its maps as sorted entries."""
    if isinstance(kind, T.ArrayType):
        return F.array_sort(F.transform(value, lambda x: _settled(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _settled(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_settled(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def consecutive(df: DataFrame, keys: Sequence[str], order: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Rows with the digest of the row before of the same key: changed is true where it differs, null for the first.

    One shuffle by key. Keys are single entities, observed now and again.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    hashed = df.withColumn("__h", content_hash(df, content))
    return hashed.withColumn("changed", F.lag("__h").over(w) != F.col("__h")).drop("__h")


def versions_archived(df: DataFrame, keys: Sequence[str], order: Sequence[str], content: Sequence[str]) -> DataFrame:
    """The states that a later one replaced, numbered from 1 by key: what an archive holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hashed = df.withColumn("__h", content_hash(df, content))
    replaced = hashed.withColumn("__next", F.lead("__h").over(w)).filter(F.col("__next") != F.col("__h"))
    return replaced.withColumn("version", F.row_number().over(w)).drop("__h", "__next")


def weekly_archive(df: DataFrame, keys: Sequence[str], order: Sequence[str], content: Sequence[str], at: str) -> DataFrame:
    """Replaced states, the first of each key, calendar year and ISO week."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__h", content_hash(df, content)).withColumn("__next", F.lead("__h").over(w)).withColumn("archived_at", F.lead(at).over(w))
    replaced = rows.filter(F.col("__next") != F.col("__h")).withColumn("year", F.year("archived_at")).withColumn("week", F.weekofyear("archived_at"))
    first = Window.partitionBy(*keys, "year", "week").orderBy("archived_at", *order)
    return replaced.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__h", "__next", "__n")


def upsert(old: DataFrame, new: DataFrame, key: str, seen: str, *, first: str, last: str) -> DataFrame:
    """Old and new rows merged by key: the newest values, the earliest ``first``, the latest ``last``; rows not seen again stay."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key)
    newest = w.orderBy(F.col("__new").desc(), F.col(seen).desc_nulls_last())
    merged = both.withColumn("__first", F.min(first).over(w)).withColumn("__last", F.max(last).over(w)).withColumn("__n", F.row_number().over(newest))
    return merged.filter("__n = 1").withColumn(first, F.col("__first")).withColumn(last, F.col("__last")).drop("__new", "__n", "__first", "__last")


def removed(stored: DataFrame, seen: DataFrame, key: str, at: str) -> DataFrame:
    """Stored rows whose key wasn't seen, with the time of their removal."""
    return stored.join(seen.select(key).distinct(), key, "left_anti").withColumn("removed_at", F.lit(at).cast("timestamp_ntz"))


def refreshed_uploads(old: DataFrame, new: DataFrame, group: str, at: str) -> DataFrame:
    """New uploads, and the old ones that are older than the oldest new one of their group; groups without new ones keep theirs."""
    oldest = new.groupBy(group).agg(F.min(at).alias("__oldest"))
    kept = old.join(oldest, group, "left").filter(F.col("__oldest").isNull() | (F.col(at) < F.col("__oldest"))).drop("__oldest")
    return new.unionByName(kept)


def merge_ordered(old: Sequence[str] | None, new: Sequence[str] | None) -> list[str]:
    """Two lists as one that keeps the order of both where it can, without repeats."""
    old, new = list(old if old is not None else ()), list(new if new is not None else ())
    out: list[str] = []
    for tag, a, b, c, d in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        out += old[a:b] if tag != "insert" else []
        out += new[c:d] if tag in ("insert", "replace") else []
    return list(dict.fromkeys(out))


def drops_anything(old: Sequence[str] | None, new: Sequence[str] | None) -> bool:
    """Whether the way from old to new replaces or deletes: then the old list is archived."""
    ops = SequenceMatcher(None, list(old if old is not None else ()), list(new if new is not None else ()), autojunk=False).get_opcodes()
    return any(tag in ("replace", "delete") for tag, *_ in ops)


def merged_lists(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For rows with old and new lists: the merged list, and whether the old one is to be archived. Row by row, without shuffle."""
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", merged array<string>, archive boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = list(zip(pdf["old"], pdf["new"]))
            yield pdf[list(keys)].assign(merged=[merge_ordered(a, b) for a, b in pairs], archive=[drops_anything(a, b) for a, b in pairs])

    return df.select(*keys, "old", "new").mapInPandas(run, schema)


def log_tail(df: DataFrame, order: Sequence[str], at: str, oldest: str, offset: int = 0) -> DataFrame:
    """The rows of a log behind the newest one that is no later than ``oldest``; the newest ``offset`` rows aren't looked at for it.

    If there is no such row all rows are given, and likewise if it is the last
    row of the log, as the original has it. ``order``: the columns in which the log
    grows; a few keys come to the driver, and no row is numbered.
    """
    key = F.struct(*order)
    newest = [r["k"] for r in df.select(key.alias("k")).orderBy(F.col("k").desc()).limit(offset + 1).collect()]
    if len(newest) <= offset:
        return df
    literal = lambda row: F.struct(*(F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order))
    stop = df.filter((key <= literal(newest[offset])) & (F.col(at) <= F.lit(oldest).cast(df.schema[at].dataType))).agg(F.max(key).alias("k")).first()["k"]
    return df if stop is None or stop == newest[0] else df.filter(key > literal(stop))


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[str], works: str, budget: int) -> DataFrame:
    """Rows until so many have done work; rows that needed none are free."""
    past = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col(works).cast("int")).over(past), F.lit(0))
    return df.withColumn("__used", used).filter(F.col("__used") < budget).drop("__used")


def whole_pages(df: DataFrame, group: Sequence[str], page: str, cap: int) -> DataFrame:
    """Rows page by page until a page reaches the cap, which is kept whole."""
    counts = df.groupBy(*group, page).agg(F.count(F.lit(1)).alias("__n"))
    past = Window.partitionBy(*group).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    kept = counts.withColumn("__before", F.coalesce(F.sum("__n").over(past), F.lit(0))).filter(F.col("__before") < cap).select(*group, page)
    return df.join(kept, [*group, page], "left_semi")
