import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from loomspan.llm import boilerplate
from loomspan.llm.boilerplate import Summaries, repeated_lines, without_lines


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc string, source string, text string, key string, n int, keys string")


def brute(rows, minimum=5):
    key = lambda s: "".join(c for c in s.upper().lower() if c.isalnum())
    seen = {}
    for d, s, t, *_ in rows:
        for line in (t or "").split("\n"):
            if s is not None and key(line):
                seen.setdefault((s, key(line)), set()).add(d)
    return {(d, n) for d, s, t, *_ in rows if s is not None for n, line in enumerate((t or "").split("\n")) if len(seen.get((s, key(line)), ())) >= minimum}


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    parts = ["Follow us!", "FOLLOW  us", "* follow us *", "----", "", "© 2024 Straße", "© 2024 STRASSE", "ok\r", "I like " + "long " * 20_000, "a b", "ab"]
    rows = [(f"d{n}", rnd.choice(["s", "t", None]), rnd.choice([None, ""] + ["\n".join(rnd.choices(parts + [f"unique {n}"], k=4))] * 8), "k", 1, "z") for n in range(60)]
    df = docs(spark, rows)
    want = brute(rows)
    assert {tuple(r) for r in repeated_lines(df).collect()} == want
    monkeypatch.setattr(boilerplate, "BROADCAST_LINES", 0)
    found = repeated_lines(df)
    assert {tuple(r) for r in found.collect()} == want
    text = {r.doc: r.text for r in without_lines(df, found).collect()}
    for d, _, t, *_ in rows:
        kept = t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in want)
        assert text[d] == kept


def test_empty(spark):
    df = docs(spark, [])
    assert repeated_lines(df).collect() == [] and without_lines(df, repeated_lines(df)).collect() == []
    assert repeated_lines(docs(spark, [("d", "s", "x\nx\nx\nx\nx\nx", "k", 1, "z")])).collect() == []


@pytest.mark.parametrize("part,held", [(250_000, 1_000_000), (50, 40)])
def test_summaries_find_exactly_the_heavy_lines_of_each_source(spark, monkeypatch, part, held):
    monkeypatch.setattr(boilerplate, "PART_LINES", part)
    monkeypatch.setattr(boilerplate, "HELD_LINES", held)
    rnd = np.random.default_rng(0)
    many = rnd.integers(-(2**60), 2**60, 40)
    rows = []
    for doc in range(300):
        source = "hot" if doc % 3 else f"s{doc % 7}"
        rows.append((source, [int(x) for x in {*rnd.choice(many, 3), *rnd.integers(-(2**60), 2**60, 5)}]))
    counts = Counter((s, p) for s, ps in rows for p in ps)
    want = {k for k, n in counts.items() if n >= 5}
    got = Summaries.heavy(spark.createDataFrame(rows, "source string, pairs array<long>").repartition(5), 5).collect()
    assert sorted((r.source, r.pair) for r in got) == sorted(want) and want


def test_singletons_are_no_candidates_at_any_size():
    rnd = np.random.default_rng(1)
    batch = pd.DataFrame({"source": ["a"] * 10, "parts": 8, "pairs": list(rnd.integers(-(2**62), 2**62, (10, 300_000)))})
    rows = pd.concat(Summaries.build(iter([batch]))).sort_values(["source", "part"])
    assert rows["lines"].map(len).sum() == 8 * 3_000_000
    assert sum(len(found) for found in Summaries.merge(5)(iter([rows]))) == 0
