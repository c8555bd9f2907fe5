"""Bitemporal history of changing attributes: valid time and recorded time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.latest import hot_keys

#: A key with more observations than this is swept in several blocks of valid time.
HOT_ROWS = 200_000
#: Days of valid time in a block of such a key.
BLOCK_DAYS = 30

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_KEY = ["entity", "entity_id", "block"]


def clean_count(value: Column) -> Column:
    """A whole number, as text, once whitespace (Unicode) and commas are removed; else null."""
    digits = F.regexp_replace(value, r"(?U)[\s,]+", "")
    return F.when(digits.rlike(r"^[0-9]{1,38}$"), digits.cast("decimal(38,0)").cast("string"))


def clean_title(value: Column) -> Column:
    """Text without outer whitespace (Unicode); blank is null."""
    bare = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def _micros(name: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, CAST(`{name}` AS TIMESTAMP_NTZ))")


def _instant(name: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, `{name}`, {_EPOCH})").alias(name)


class _Stairs:
    """Earliest later valid time as a function of recorded time.

    Entries (recorded, valid) with recorded rising and valid falling. An
    observation that is swept (valid time falls during the sweep) hides every
    entry recorded no sooner, so only late arrivals keep more than one.
    """

    __slots__ = ("at",)

    def __init__(self) -> None:
        self.at: list[tuple[int, int]] = []

    def push(self, recorded: int, valid: int) -> None:
        at = self.at
        while at and at[-1][0] >= recorded:
            at.pop()
        at.append((recorded, valid))


def _groups(batches: Iterator[pd.DataFrame], names: Sequence[str]) -> Iterator[tuple]:
    for pdf in batches:
        yield from zip(*(pdf[n].tolist() for n in names))


def _sweep(values: Sequence[str], stairs_only: bool):
    """Sweep rows sorted by key, valid time descending, recorded time descending."""
    names = [*_KEY, "valid_at", "seen_at", "boundary", *values]
    out = [*_KEY, "recorded", "valid"] if stairs_only else ["entity", "entity_id", *values, "valid_from", "valid_to", "recorded_from", "recorded_to"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stairs, found = None, _Stairs(), []
        at, first, until = None, None, None  # of the valid time being swept: itself, its earliest record, the record that supersedes

        def frame() -> pd.DataFrame:
            pdf = pd.DataFrame(found, columns=out).astype({n: "Int64" for n in out if n.startswith(("valid", "recorded"))})
            found.clear()
            return pdf

        for row in _groups(batches, names):
            entity, entity_id, block, valid, seen, boundary = row[:6]
            if (entity, entity_id, block) != key:
                if stairs_only and key is not None:
                    if at is not None:
                        stairs.push(first, at)
                    found.extend((*key, r, v) for r, v in stairs.at)
                key, stairs, at = (entity, entity_id, block), _Stairs(), None
            if valid != at:
                if at is not None:
                    stairs.push(first, at)
                at, until = valid, None
            elif seen == first and not boundary:
                continue  # a repeated row, or a tie, of which the greatest values count
            first = seen
            if not (boundary or stairs_only):
                start, end = seen, None
                for r, v in stairs.at:
                    if r <= seen:
                        end = v
                        continue
                    if until is not None and r >= until:
                        break
                    if r > start:
                        found.append((entity, entity_id, *row[6:], valid, end, start, r))
                    start, end = r, v
                found.append((entity, entity_id, *row[6:], valid, end, start, until))
            until = seen
            if len(found) >= 20_000:
                yield frame()
        if stairs_only and key is not None:
            stairs.push(first, at)
            found.extend((*key, r, v) for r, v in stairs.at)
        if found:
            yield frame()

    return run


def _later_stairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block of a key, the stairs of all later blocks together."""
    found, stairs = [], _Stairs()
    blocks = {b: g for b, g in pdf.groupby("block")}
    for block in sorted(blocks, reverse=True):
        key = tuple(blocks[block].iloc[0][_KEY])
        found.extend((*key, v, r) for r, v in stairs.at)
        for r, v in sorted(zip(blocks[block]["recorded"], blocks[block]["valid"]), key=lambda x: -x[1]):
            stairs.push(int(r), int(v))
    return pd.DataFrame(found, columns=[*_KEY, "valid_at", "seen_at"])


def _with_blocks(rows: DataFrame, hot: DataFrame | None, valid: str) -> DataFrame:
    if hot is None:
        return rows.withColumn("block", F.lit(0).cast("long"))
    marked = rows.join(hot.withColumn("__hot", F.lit(True)), ["entity", "entity_id"], "left")
    width = BLOCK_DAYS * 86_400_000_000
    return marked.withColumn("block", F.when(F.col("__hot"), F.floor(F.col(valid) / F.lit(width))).otherwise(0).cast("long")).drop("__hot")


def hot_entities(observations: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The entities with more than ``hot_rows`` rows, or null if there are none; counted with map-side combining."""
    hot = hot_keys(observations.select("entity", "entity_id"), ["entity", "entity_id"], hot_rows)
    return None if hot.isEmpty() else hot


_COUNT = "count"


def bitemporal_ledger(
    observations: DataFrame,
    *,
    values: Sequence[str],
    valid_at: str = "valid_at",
    seen_at: str = "seen_at",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None | str = _COUNT,
) -> DataFrame:
    """Every statement ever recorded about an entity, with both its periods.

    ``observations``: entity, entity_id, the valid time at which the values
    were read, the time the reading was received, and text columns ``values``.
    One sweep over valid time, latest first, keeps the stairs of later readings
    by their time of receipt. So a reading that arrives late splits the period
    it falls in: the row it splits stays, its recorded period ends, and the two
    parts are recorded from then on. A later receipt for the same valid time
    supersedes the former likewise. No row is ever overwritten; the belief at
    any time is the rows whose recorded period holds that time.

    Returns entity, entity_id, the values as read, valid_from, valid_to
    (null: open), recorded_from, recorded_to (null: still believed).

    A null time of receipt counts as the earliest. Rows without entity id or
    valid time can't be placed and are left out; repeated rows count once; of
    different rows with both times equal the one with the greatest values
    counts (nulls least). Empty in, empty out; other columns are ignored.

    Cost: one shuffle by entity; the sweep streams sorted rows and holds no
    entity in memory. An entity with more than ``hot_rows`` rows is swept in
    blocks of valid time, each given the stairs of all later blocks. Give ``hot``
    (hot_entities of the observations) where they are counted already.
    """
    rows = observations.select(
        "entity", "entity_id", _micros(valid_at).alias("valid_at"), F.coalesce(_micros(seen_at), F.lit(-(2**62))).alias("seen_at"), *values
    ).filter(F.col("entity_id").isNotNull() & F.col("valid_at").isNotNull())
    hot = hot_entities(rows, hot_rows) if isinstance(hot, str) else hot
    order = [*_KEY, F.col("valid_at").desc(), F.col("seen_at").desc(), F.col("boundary").desc(), *(F.col(v).desc_nulls_last() for v in values)]
    blocks = _with_blocks(rows, hot, "valid_at").withColumn("boundary", F.lit(False))
    if hot is not None:
        own = blocks.join(hot, ["entity", "entity_id"], "left_semi")
        stairs = own.repartition(*_KEY).sortWithinPartitions(*order).mapInPandas(
            _sweep(values, True), "entity string, entity_id string, block long, recorded long, valid long"
        )
        edge = stairs.groupBy("entity", "entity_id").applyInPandas(_later_stairs, "entity string, entity_id string, block long, valid_at long, seen_at long")
        edge = edge.join(own.select(*_KEY).distinct(), _KEY, "left_semi").withColumn("boundary", F.lit(True))
        blocks = blocks.unionByName(edge, allowMissingColumns=True)
    schema = ", ".join(["entity string", "entity_id string", *(f"`{v}` string" for v in values), *(f"{n} long" for n in ("valid_from", "valid_to", "recorded_from", "recorded_to"))])
    swept = blocks.repartition(*_KEY).sortWithinPartitions(*order).mapInPandas(_sweep(values, False), schema)
    return swept.select("entity", "entity_id", *values, *(_instant(n) for n in ("valid_from", "valid_to", "recorded_from", "recorded_to")))


def versions(ledger: DataFrame, *, values: Sequence[str], hot_rows: int = HOT_ROWS, hot: DataFrame | None | str = _COUNT) -> DataFrame:
    """The versions of each entity as believed now.

    Takes the still believed rows of a ledger. A missing (null) value leaves the
    former one in force; a version begins where any value differs from the
    version before (the first reading begins the first) and ends where the next
    begins, null for the last. Returns entity, entity_id, values, valid_from, valid_to.

    An entity with more than ``hot_rows`` readings is worked in blocks of valid
    time; what carries over from block to block is joined, one row per block.
    ``hot``: hot_entities of the observations (no fewer than those of the
    ledger), so that the ledger isn't swept once more to count them.
    """
    now = ledger.filter(F.col("recorded_to").isNull()).select("entity", "entity_id", _micros("valid_from").alias("at"), *values)
    hot = hot_entities(now, hot_rows) if isinstance(hot, str) else hot
    now = _with_blocks(now, hot, "at")
    order = Window.partitionBy(*_KEY).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(order) == 1
    if hot is None:
        filled = now.select(*_KEY, "at", *(F.last(v, ignorenulls=True).over(upto).alias(v) for v in values))
        started = F.lit(False)
        before = {v: F.lag(v).over(order) for v in values}
    else:
        ends = now.groupBy(*_KEY).agg(*(F.max(F.when(F.col(v).isNotNull(), F.struct("at", v)))[v].alias(f"__{v}") for v in values))
        over = Window.partitionBy("entity", "entity_id").orderBy("block")
        past = over.rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(*_KEY, (F.row_number().over(over) > 1).alias("__started"), *(F.last(f"__{v}", ignorenulls=True).over(past).alias(f"__{v}") for v in values))
        both = now.join(carry, _KEY)
        filled = both.select(
            *_KEY, "at", "__started", *(f"__{v}" for v in values), *(F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"__{v}")).alias(v) for v in values)
        )
        started = F.col("__started")
        before = {v: F.when(first, F.col(f"__{v}")).otherwise(F.lag(v).over(order)) for v in values}
    differs = reduce(lambda a, b: a | b, (~F.col(v).eqNullSafe(before[v]) for v in values))
    begun = filled.withColumn("__new", F.when(first & ~started, True).otherwise(differs)).filter("__new").select(*_KEY, "at", *values)
    until = F.lead("at").over(order)
    if hot is None:
        ended = begun.withColumn("until", until)
    else:
        starts = begun.groupBy(*_KEY).agg(F.min("at").alias("__at"))
        future = Window.partitionBy("entity", "entity_id").orderBy("block").rowsBetween(1, 1)
        nexts = starts.select(*_KEY, F.first("__at").over(future).alias("__next"))
        ended = begun.join(nexts, _KEY).withColumn("until", F.coalesce(until, F.col("__next")))
    ended = ended.withColumnsRenamed({"at": "valid_from", "until": "valid_to"})
    return ended.select("entity", "entity_id", *values, _instant("valid_from"), _instant("valid_to"))
