"""Captions of transcripts in their six notations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(?:\d+:)?\d{1,3}:\d{2}(?:[.,]\d+)?"
_SRT = re.compile(rf"^({_CLOCK})\s*-->\s*{_CLOCK}.*$")
_MARKS = (
    re.compile(rf"^\s*({_CLOCK})\s*\|\s?(.*)$"),
    re.compile(rf"^\s*\[({_CLOCK})\]\s?(.*)$"),
    re.compile(r"^\s*\((\d+(?:\.\d+)?)\s?s\)\s?(.*)$"),
    re.compile(r"^\s*(\d+(?:\.\d+)?):(?:\s(.*)|())$"),
    re.compile(rf"^\s*({_CLOCK})(?:\s(.*)|())$"),
)
#: A time mark in the plainest form further than this from both neighbours is a time that was spoken.
_FAR_MS = 60_000


def _ms(mark: str) -> int:
    parts = [float(p.replace(",", ".")) for p in mark.split(":")]
    seconds = 0.0
    for p in parts:
        seconds = seconds * 60 + p
    return round(seconds * 1000)


def captions(chunk: str | None) -> list[tuple[int, str]]:
    """(start in ms, text) of the captions of a chunk, in the order given.

    The notation is the one that marks most lines: subtitle blocks, a clock
    with a bar, in brackets or bare, seconds with a colon or in parentheses. Lines
    without a mark go on with the caption above; text before the first mark is
    the end of a caption that an earlier chunk has whole.
    """
    if not chunk:
        return []
    lines = chunk.split("\n")
    if any(_SRT.match(line) for line in lines):
        found: list[list] = []
        for n, line in enumerate(lines):
            if m := _SRT.match(line):
                found.append([_ms(m[1]), []])
            elif found and not (line.strip().isdigit() and n + 1 < len(lines) and _SRT.match(lines[n + 1])):
                found[-1][1].append(line)
        return [(t, " ".join(" ".join(text).split())) for t, text in found]
    form = max(_MARKS, key=lambda f: sum(f.match(line) is not None for line in lines))
    marks = [form.match(line) for line in lines]
    times = [(n, _ms(m[1])) for n, m in enumerate(marks) if m]
    if form is _MARKS[4]:
        for k in range(1, len(times) - 1):  # the first and last have no neighbours on both sides that could agree
            n, t = times[k]
            near = [times[j][1] for j in (k - 1, k + 1)]
            if all(abs(t - x) > _FAR_MS for x in near) and abs(near[0] - near[1]) <= _FAR_MS:
                marks[n] = None
    found = []
    for line, m in zip(lines, marks):
        if m:
            found.append([_ms(m[1]), [m[2] or ""]])
        elif found:
            found[-1][1].append(line)
    return [(t, " ".join(" ".join(text).split())) for t, text in found]


_SECONDS = re.compile(r"\d+: ")


def in_seconds(chunk: str | None) -> str | None:
    """The chunk as lines 'second: text'; one in that notation, or without any time mark, as it is."""
    if not chunk or _SECONDS.match(chunk):
        return chunk
    return "\n".join(f"{t // 1000}: {text}" for t, text in captions(chunk)) or chunk


def second_lines(chunk: Column) -> Column:
    """Chunks of any notation as lines 'second: text'."""

    @F.pandas_udf("string")
    def lines(chunks: pd.Series) -> pd.Series:
        return chunks.map(in_seconds, na_action="ignore")

    return lines(chunk)
