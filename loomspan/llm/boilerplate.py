"""Lines repeated across one source's documents: found and removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import materialize

#: Documents of one source a line must stand in.
MIN_DOCUMENTS = 5
#: Lines that one summary counts, about; the summary of a source with more is divided by hash.
PART_LINES = 250_000
#: Lines that a task counts before it hands its summaries on.
HELD_LINES = 1_000_000
#: Confirmed lines, candidates and large sources are broadcast up to this number (16 bytes of hash and a source each), and joined by shuffle beyond.
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """128 bits of hash over a line's letters and digits, without case; null for a line without any."""
    letters = F.lower(F.upper(F.regexp_replace(line, r"[^\p{L}\p{N}]+", "")))
    letters = F.translate(F.regexp_replace(letters, "ß", "ss"), "ς", "σ")
    return F.when(letters != "", F.struct(F.xxhash64(letters, F.lit(1)).alias("a"), F.xxhash64(letters, F.lit(2)).alias("b")))


class Summaries:
    """Heavy-hitter summaries of the lines of each source.

    A summary is the sorted hashes of lines (64 bits) with a counter each. Two
    of the same source merge by adding the counters of equal hashes, in any
    order. As a minimum of a few documents is asked for, whatever the size of
    the source, a counter may only be dropped once its final value is known: so
    summaries have as many counters as they need, are divided into parts that no
    task need fear, and drop what is below the minimum when all of a part is merged.
    """

    @staticmethod
    def _added(group: np.ndarray, line: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counters of equal (group, line) added up, sorted by both."""
        order = np.lexsort((line, group))
        group, line, count = group[order], line[order], count[order]
        first = np.ones(len(line), bool)
        first[1:] = (group[1:] != group[:-1]) | (line[1:] != line[:-1])
        at = np.flatnonzero(first)
        return group[at], line[at], (np.add.reduceat(count, at) if len(at) else count)

    @classmethod
    def build(cls, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """source, part, lines, counts of what a task has read, from rows of source, parts, pairs."""
        held: list[tuple] = []
        n = 0

        def summed() -> pd.DataFrame:
            codes, names = pd.factorize(np.concatenate([h[0] for h in held]))
            parts, lines = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            most = int(parts.max()) + 1
            group, line, count = cls._added(codes * most + parts, lines, np.ones(len(lines), np.int64))
            at = np.flatnonzero(np.diff(group, prepend=-1))
            ends = [*at[1:], len(group)]
            held.clear()
            return pd.DataFrame({
                "source": names[group[at] // most], "part": (group[at] % most).astype(np.int32),
                "lines": [line[a:b].tobytes() for a, b in zip(at, ends)], "counts": [count[a:b].astype(np.uint32).tobytes() for a, b in zip(at, ends)],
            })

        for pdf in batches:
            lengths = pdf["pairs"].map(len).to_numpy()
            if not lengths.sum():
                continue
            lines = np.concatenate(pdf["pairs"].to_numpy()).astype(np.int64)
            held.append((np.repeat(pdf["source"].to_numpy(), lengths), lines % np.repeat(pdf["parts"].to_numpy(np.int64), lengths), lines))
            n += len(lines)
            if n >= HELD_LINES:
                yield summed()
                n = 0
        if held:
            yield summed()

    @classmethod
    def merge(cls, minimum: int):
        """Rows sorted by source and part become the lines (source, pair) whose counters reach the minimum."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            waiting: pd.DataFrame | None = None

            def merged(rows: pd.DataFrame) -> pd.DataFrame:
                of_row = rows.groupby(["source", "part"], sort=False).ngroup().to_numpy()
                lines = [np.frombuffer(x, np.int64) for x in rows["lines"]]
                counts = [np.frombuffer(x, np.uint32) for x in rows["counts"]]
                lengths = [len(x) for x in lines]
                group, line, count = cls._added(np.repeat(of_row, lengths), np.concatenate(lines), np.concatenate(counts).astype(np.int64))
                names = rows["source"].to_numpy()[np.unique(of_row, return_index=True)[1]]
                kept = count >= minimum
                return pd.DataFrame({"source": names[group[kept]], "pair": line[kept]})

            for pdf in batches:
                rows = pdf if waiting is None else pd.concat([waiting, pdf], ignore_index=True)
                last = rows.iloc[-1] if len(rows) else None
                if last is None:
                    continue
                open_ = ((rows["source"] == last["source"]) & (rows["part"] == last["part"])).to_numpy()
                waiting = rows[open_].reset_index(drop=True)
                if not open_.all():
                    yield merged(rows[~open_].reset_index(drop=True))
            if waiting is not None:
                yield merged(waiting)

        return run

    @classmethod
    def heavy(cls, lines: DataFrame, minimum: int) -> DataFrame:
        """source, pair of the lines that reach the minimum, from rows of source, pairs (hashes of a document's different lines)."""
        large = lines.groupBy("source").agg(F.sum(F.size("pairs")).alias("n")).filter(F.col("n") > PART_LINES)
        large = large.select("source", F.ceil(F.col("n") / PART_LINES).cast("int").alias("parts"))
        sized = lines.join(few(large), "source", "left").select("source", F.coalesce("parts", F.lit(1)).alias("parts"), "pairs")
        kind = dict(lines.dtypes)["source"]
        partial = sized.mapInPandas(cls.build, f"source {kind}, part int, lines binary, counts binary")
        together = partial.repartition("source", "part").sortWithinPartitions("source", "part")
        return together.mapInPandas(cls.merge(minimum), f"source {kind}, pair long")


def few(df: DataFrame) -> DataFrame:
    """A written table marked for broadcast if it has at most BROADCAST_LINES rows, else as it is."""
    df = materialize(df)
    return F.broadcast(df) if df.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else df


def repeated_lines(documents: DataFrame, *, minimum: int = MIN_DOCUMENTS) -> DataFrame:
    """The lines (doc, line_no from 0) whose text stands in ``minimum`` or more documents of the same source.

    ``documents``: doc (unique), source, text. Lines are split at line feeds;
    two are the same if their letters and digits agree in order, without case
    (128 bits of hash stand for them). Lines without any are never found, nor
    are lines of documents whose source or text is null. A line that is repeated
    within a document counts once; each of its places is found.

    Three passes over hashes, one array of them a document: summaries of each
    source, built where its documents lie and merged in one shuffle; exact counts
    (128 bits) of the lines whose summaries reach the minimum; a join with the
    confirmed lines, which are broadcast if they are few enough and shuffled if
    not. A hot source is no hot group: its summary is divided by hash.
    """
    keys = F.transform(F.split(F.col("text"), "\n", -1), line_key)
    lines = materialize(documents.filter(F.col("source").isNotNull() & F.col("text").isNotNull()).select("doc", "source", keys.alias("keys")))
    different = F.array_distinct(F.array_compact("keys"))
    pairs = F.transform(different, lambda k: F.xxhash64("source", k["a"], k["b"]))
    heavy = Summaries.heavy(lines.select("source", pairs.alias("pairs")), minimum)
    once = lines.select("source", F.explode(different).alias("key")).withColumn("pair", F.xxhash64("source", "key.a", "key.b"))
    counted = once.join(few(heavy), ["source", "pair"], "left_semi").groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))
    confirmed = few(counted.filter(F.col("n") >= minimum).select("source", "key"))
    places = lines.select("doc", "source", F.posexplode("keys").alias("line_no", "key")).filter(F.col("key").isNotNull())
    return places.join(confirmed, ["source", "key"], "left_semi").select("doc", "line_no")


def without_lines(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc, text without the found lines, and the number removed; null text stays null.

    A document keeps its other lines in order; one of repeated lines alone comes out empty.
    """
    per = found.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))
    split = F.split(F.col("text"), "\n", -1)
    kept = F.filter(split, lambda line, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return documents.join(per, "doc", "left").select("doc", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
