"""Chapters of descriptions, headings of transcripts, and transcripts in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.text import SPACE, strip

#: Seconds within which a chapter and a heading are one.
SNAP = 30
CHUNK_ROWS = 400
CHUNK_STEP = 370

# A line's time, whatever signs stand around it; the title is the rest of the line. Signs may run over line ends.
_MARK = r"(?md)^[^\p{L}\p{N}_]*((?:\d{1,2}:)?\d{1,2}:\d{2})[^\p{L}\p{N}_]*(.*?)$"


def clock_seconds(mark: Column) -> Column:
    return F.aggregate(F.split(mark, ":"), F.lit(0), lambda t, x: t * 60 + x.cast("int"))


def chapter_marks(description: Column) -> Column:
    """(offset, title) of every line of a description that begins with a time; titles may be empty."""
    marks = F.regexp_extract_all(description, F.lit(_MARK), 1)
    titles = F.regexp_extract_all(description, F.lit(_MARK), 2)
    return F.zip_with(marks, titles, lambda m, t: F.struct(clock_seconds(m).alias("offset"), m.alias("mark"), strip(t).alias("title")))


def rewritten_marks(description: Column) -> Column:
    """The description with [ts N] time title for each such line."""
    out = F.regexp_replace(description, _MARK, "[ts $1] $1 $2")
    found = F.array_distinct(F.regexp_extract_all(description, F.lit(_MARK), 1))
    return F.rtrim(F.aggregate(found, out, lambda text, m: F.replace(text, F.concat(F.lit("[ts "), m, F.lit("]")), F.concat(F.lit("[ts "), clock_seconds(m).cast("string"), F.lit("]")))))


def headings(text: Column) -> Column:
    """(offset, level, title) of lines '<seconds> ## title', with 1 to 6 number signs."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"^\s*\d+\s+#{1,6}\s+\S"))
    part = lambda x, n: F.regexp_extract(x, rf"^\s*(\d+)\s+(#{{1,6}})\s+(.+?)[{SPACE}]*$", n)
    return F.transform(lines, lambda x: F.struct(part(x, 1).cast("int").alias("offset"), F.length(part(x, 2)).alias("level"), part(x, 3).alias("title")))


def heading_line(offset: Column, level: Column, title: Column) -> Column:
    return F.concat_ws(" ", offset.cast("string"), F.repeat(F.lit("#"), level), title)


def line_second(line: Column) -> Column:
    """The second before a line's first colon; null for headings and other text."""
    head = strip(F.substring_index(line, ":", 1))
    return F.when(line.contains(":") & ~line.startswith("##") & head.rlike(r"^[+-]?\d{1,9}$"), head.cast("int"))


def intervals(chapters: DataFrame, key: str, start: str = "offset") -> DataFrame:
    """Chapters with chapter_no (from 0) and the start of the next (null for the last)."""
    w = Window.partitionBy(key).orderBy(start)
    return chapters.withColumn("chapter_no", F.row_number().over(w) - 1).withColumn("next_start", F.lead(start).over(w))


def chapter_at(times: DataFrame, chapters: DataFrame, key: str, second: str) -> DataFrame:
    """``times`` with the chapter that holds them: the latest that begins no later; null before the first.

    An as-of join: equal on the key, half-open on the interval. Chapters of a key are few.
    """
    held = intervals(chapters, key).select(F.col(key).alias("__k"), "chapter_no", "offset", "next_start")
    on = (F.col(key) == F.col("__k")) & (F.col(second) >= F.col("offset")) & (F.col("next_start").isNull() | (F.col(second) < F.col("next_start")))
    return times.join(held, on, "left").drop("__k", "offset", "next_start")


def near_pairs(manual: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Chapters and headings of the same key within SNAP seconds of each other.

    A band join on the key and the bucket of SNAP seconds: each chapter looks into its own bucket and the two beside it.
    """
    left = manual.select(key, F.col("offset").alias("m_offset"), F.col("title").alias("m_title"), F.explode(F.array(*(F.floor(F.col("offset") / SNAP) + d for d in (-1, 0, 1)))).alias("__b"))
    right = found.select(key, F.col("offset").alias("h_offset"), "level", F.floor(F.col("offset") / SNAP).alias("__b"))
    return left.join(right, [key, "__b"]).filter(F.abs(F.col("m_offset") - F.col("h_offset")) <= SNAP).drop("__b")


def merge_chapters(found: Sequence[tuple[int, int, str]], manual: Sequence[tuple[int, str]], duration: int | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
    """Headings with the titles of the chapters near them, and the chapters that found none.

    Chapters are taken in order. Each takes, of the headings within SNAP seconds
    that none has taken, the one of the highest level, then the nearest. First of
    all a chapter at 0 is put at 0 and the last one near the end at the end:
    they take the nearest heading, or make one of level 2. (One that is made so
    isn't taken: a later chapter may still take it.) At last the first heading is
    drawn to 0 and the last of several to the end, if they are near.
    """
    rows, taken, left = [list(h) for h in found], set(), []

    def nearest(offset: int, by_level: bool) -> int | None:
        near = [(h[1] if by_level else 0, abs(h[0] - offset), n) for n, h in enumerate(rows) if n not in taken and abs(h[0] - offset) <= SNAP]
        return min(near)[2] if near else None

    def bookend(offset: int, title: str) -> None:
        n = nearest(offset, False)
        if n is None:
            rows.append([offset, 2, title])
        else:
            rows[n][0], rows[n][2] = offset, title
            taken.add(n)

    done = set()
    first = next((n for n, (offset, _) in enumerate(manual) if offset == 0), None)
    if first is not None:
        bookend(0, manual[first][1])
        done.add(first)
    if duration:
        last = next((n for n in reversed(range(len(manual))) if n not in done and abs(manual[n][0] - duration) <= SNAP), None)
        if last is not None:
            bookend(duration, manual[last][1])
            done.add(last)
    for n, (offset, title) in enumerate(manual):
        if n in done:
            continue
        at = nearest(offset, True)
        if at is None:
            left.append((offset, title))
        else:
            rows[at][2] = title
            taken.add(at)
    rows.sort(key=lambda h: h[0])
    if rows and 0 < rows[0][0] <= SNAP:
        rows[0][0] = 0
    if rows and duration and len(rows) > 1 and 0 < duration - rows[-1][0] <= SNAP:
        rows[-1][0] = duration
    return [tuple(h) for h in rows], left


def merged_headings(df: DataFrame, key: str) -> DataFrame:
    """merge_chapters for rows with arrays found and manual, and duration: ``key``, headings, unmatched. Row by row, without shuffle."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, found, manual, duration in zip(*(pdf[c] for c in (key, "found", "manual", "duration"))):
                a = [(h["offset"], h["level"], h["title"]) for h in (found if found is not None else ())]
                b = [(m["offset"], m["title"]) for m in (manual if manual is not None else ())]
                rows, left = merge_chapters(a, b, None if pd.isna(duration) else int(duration))
                out.append((k, [dict(zip(("offset", "level", "title"), r)) for r in rows], [dict(zip(("offset", "title"), r)) for r in left]))
            yield pd.DataFrame(out, columns=[key, "headings", "unmatched"])

    return df.select(key, "found", "manual", "duration").mapInPandas(run, f"`{key}` {kind}, headings array<struct<offset:int,level:int,title:string>>, unmatched array<struct<offset:int,title:string>>")


def chunk_windows(rows: DataFrame, position: str) -> DataFrame:
    """Rows with the chunks (of 400, one each 370) they belong to: one or two."""
    p = F.col(position)
    first = F.greatest(F.lit(0), F.ceil((p - (CHUNK_ROWS - 1)) / CHUNK_STEP)).cast("int")
    return rows.withColumn("chunk_no", F.explode(F.sequence(first, F.floor(p / CHUNK_STEP).cast("int"))))


def trimmed_chunks(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Chunks cut where the next one begins: lines from the first whose second is not before the first second of the next chunk are dropped, then headings.

    A cut depends on the next chunk alone, so one window suffices. A chunk whose
    successor has no second stays whole.
    """
    lines = F.split(strip(F.col(text)), "\n", -1)
    first = F.get(F.filter(F.transform(lines, line_second), lambda s: s.isNotNull()), 0)
    w = Window.partitionBy(key).orderBy(order)
    nxt = chunks.withColumn("__next", F.lead(first).over(w)).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    cut = F.filter(F.transform(lines, lambda x, i: F.when(line_second(x) >= F.col("__next"), i)), lambda i: i.isNotNull())
    kept = F.when(F.col("__next").isNull(), F.split(F.col(text), "\n", -1)).otherwise(F.slice(lines, F.lit(1), F.coalesce(F.get(cut, 0), F.size(lines))))
    bare = F.filter(kept, lambda x: ~F.ltrim(x).startswith("##"))
    return nxt.withColumn(text, F.array_join(bare, "\n")).drop("__next", "__last")


def interleaved(transcript: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Lines of a transcript and of its headings in order of time, a heading before text of the same second. Columns: key, second, is_text, pos, line."""
    text = transcript.select(key, "second", F.lit(1).alias("is_text"), "pos", "line")
    return text.unionByName(heads.select(key, "second", F.lit(0).alias("is_text"), "pos", "line"))


def last_paragraphs(text: Column, n: int = 2) -> Column:
    """The last lines that begin with a second and a colon."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"^\d+:\s"))
    return F.when(F.size(lines) <= n, lines).otherwise(F.slice(lines, -n, n))


def best_transcript(rows: DataFrame, key: str) -> DataFrame:
    """One language of each video: English made by hand, then English, then the first by name."""
    rank = F.when(F.col("language_code").startswith("en") & ~F.col("is_generated"), 0).when(F.col("language_code").startswith("en"), 1).otherwise(2)
    w = Window.partitionBy(key).orderBy(rank, F.col("language_code").asc_nulls_last(), "is_generated")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
