import datetime as dt
import random

import pytest

from loomspan.operators.ledger import bitemporal_ledger, clean_count, clean_title, versions
from pyspark.sql import functions as F

SCHEMA = "entity string, entity_id string, valid_at timestamp_ntz, seen_at timestamp_ntz, c string, title string, key string, block string"


def at(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def observations(spark, rows):
    return spark.createDataFrame([("v", i, at(t), at(r), c, x, "k", "b") for i, t, r, c, x in rows], SCHEMA)


def believed(rows, now):
    """By brute force: versions of one entity from what was received until now."""
    one = {}
    for t, r, c, x in sorted((w for w in rows if w[1] <= now), key=lambda w: (w[1], w[3] or "", w[2] or "")):
        one[t] = (c, x)
    return one


@pytest.mark.parametrize("hot", [2, 10**6])
def test_versions_and_beliefs_match_brute_force(spark, hot):
    rnd = random.Random(4)
    rows = []
    for i in "abc":
        for _ in range(40):
            t = rnd.randrange(300)
            rows.append((i, t, t + rnd.choice([0, 1, 40, 200]), rnd.choice([None, "1", "2"]), rnd.choice([None, "x", "y"])))
    rows += rows[:5]
    ledger = bitemporal_ledger(observations(spark, rows), values=["title", "c"], hot_rows=hot)
    got = ledger.collect()
    for i in "abc":
        mine = [r[1:] for r in rows if r[0] == i]
        for now in (0, 30, 120, 250, 600):
            want = believed(mine, now)
            ts = sorted(want)
            want = {(at(t), at(n), *want[t]) for t, n in zip(ts, [*ts[1:], None])}
            seen = {
                (g.valid_from, g.valid_to, g.c, g.title)
                for g in got
                if g.entity_id == i and g.recorded_from <= at(now) and (g.recorded_to is None or g.recorded_to > at(now))
            }
            assert seen == want
    found = {(r.entity_id, r.valid_from, r.valid_to, r.c, r.title) for r in versions(ledger, values=["title", "c"], hot_rows=hot).collect()}
    want = set()
    for i in "abc":
        one, last, begun = believed([r[1:] for r in rows if r[0] == i], 10**4), None, []
        state = (None, None)
        for t in sorted(one):
            state = tuple(n if n is not None else o for n, o in zip(one[t], state))
            if not begun or state != begun[-1][1]:
                begun.append((t, state))
        want |= {(i, at(t), at(n), *s) for (t, s), n in zip(begun, [*(b[0] for b in begun[1:]), None])}
    assert found == want


def test_nulls_ties_and_empty(spark):
    rows = [(None, 1, 1, "1", "x"), ("a", None, 1, "1", "x"), ("a", 1, None, "1", "x"), ("a", 1, 5, None, None), ("a", 2, 2, "3", "z"), ("a", 2, 2, "4", "z")]
    ledger = bitemporal_ledger(observations(spark, rows), values=["title", "c"])
    now = {(r.valid_from, r.c) for r in ledger.filter("recorded_to is null").collect()}
    assert now == {(at(1), None), (at(2), "4")}
    assert [(r.valid_from, r.c) for r in versions(ledger, values=["title", "c"]).orderBy("valid_from").collect()] == [(at(1), None), (at(2), "4")]
    assert versions(bitemporal_ledger(observations(spark, []), values=["title", "c"]), values=["title", "c"]).collect() == []


def test_cleaning(spark):
    df = spark.createDataFrame([("1,023",), ("\t2 665",), ("0.1K",), ("",), (None,), ("007",), ("x" * 100_000,)], "s string")
    assert [r[0] for r in df.select(clean_count(F.col("s"))).collect()] == ["1023", "2665", None, None, None, "7", None]
    assert [r[0] for r in df.select(clean_title(F.col("s"))).collect()][:5] == ["1,023", "2 665", "0.1K", None, None]
