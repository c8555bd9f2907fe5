import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm.mixing import count_tokens, mix, sainte_lague, shard_quotas


def frames(spark, docs, targets):
    return (
        spark.createDataFrame([(d, s, t, 1, "z") for d, s, t in docs], "doc_id bigint, source string, text string, tokens int, shard string"),
        spark.createDataFrame([(s, w, m, "z") for s, w, m in targets], "source string, target_share double, max_repeats int, documents string"),
    )


def test_sainte_lague_against_plain_highest_quotients():
    rnd = random.Random(0)
    for _ in range(50):
        weights = {k: rnd.random() for k in "abcde"}
        caps = {k: rnd.choice([3, 1000]) for k in weights}
        got = sainte_lague(weights, 60, caps)
        quotients = sorted(((w / (2 * n + 1), k) for k, w in weights.items() for n in range(caps[k])), reverse=True)[:60]
        assert got == {k: sum(q[1] == k for q in quotients) for k in weights}


def test_many_seats_cost_no_loop_over_them():
    got = sainte_lague({"a": 0.6, "b": 0.3, "c": 0.1}, 10**12, {"a": 10**12, "b": 10**12, "c": 10})
    assert got["c"] == 10 and sum(got.values()) == 10**12 and abs(got["a"] - 2 * got["b"]) <= 2


@pytest.mark.parametrize("shards", [1, 20, 2000])
def test_shares_hold_at_any_number_of_shards(spark, shards):
    rnd = random.Random(shards)
    sizes = [("big", k, 60_000_000 + rnd.randrange(-10**6, 10**6)) for k in range(shards)]
    sizes += [("middle", k, 3_000_000 + rnd.randrange(-10**5, 10**5)) for k in range(max(1, shards // 3))]
    sizes += [("small", k, 1_000_000 + rnd.randrange(-10**5, 10**5)) for k in range(max(1, shards // 20))]
    targets = {"big": (0.7, 1), "middle": (0.25, 4), "small": (0.05, 4), "missing": (0.0, 1)}
    quotas = shard_quotas(spark.createDataFrame(sizes, "source string, shard int, tokens long"), targets)
    given = {r.source: r.give for r in quotas.groupBy("source").agg(F.sum("give").alias("give")).collect()}
    for s, (share, _) in targets.items():
        assert abs(given.get(s, 0) / sum(given.values()) - share) < 0.005 * max(share, 0.001)
    assert quotas.filter(F.col("give") > F.col("in_shard") * F.col("most")).isEmpty()


def test_quotas_of_shards_are_those_of_plain_quotients(spark):
    rnd = random.Random(5)
    sizes = {k: 1000 + rnd.randrange(500) for k in range(0, 256 * 40, 256)}  # all of one group
    quotas = shard_quotas(spark.createDataFrame([("a", k, n) for k, n in sizes.items()], "source string, shard int, tokens long"), {"a": (1.0, 3)}, total=30_000)
    rows = quotas.collect()
    block = rows[0].block
    want = sainte_lague({k: float(n) for k, n in sizes.items()}, 30_000 // block, {k: 10**9 for k in sizes})
    assert {r.shard: r.give // block for r in rows} == {k: n for k, n in want.items() if n}


def test_shares_and_repeats(spark):
    rnd = random.Random(1)
    sources = ["Big"] * 600 + ["big "] * 100 + ["small-one"] * 60 + ["other"] * 200 + ["untargeted"] * 30 + [None]
    docs = [(n, s, "word " * rnd.randrange(1, 120)) for n, s in enumerate(sources)]
    docs += [docs[3], docs[650], (None, "Big", "x"), (5000, "big", None), (5001, "big", ""), (5002, "other", "long " * 400)]
    targets = [("big", 0.5, 1), ("small_one", 0.3, 4), ("other", 0.1, 2), ("missing", 0.1, 3)]
    chosen, shares = mix(*frames(spark, docs, targets), shard_rows=150)
    rows = chosen.collect()
    most = {"big": 1, "small_one": 4, "other": 2}
    assert all(1 <= r.copies <= most[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    total = sum(r.tokens * r.copies for r in rows)
    got = {r.source: r for r in shares.collect()}
    for s, want in (("big", 0.5 / 0.9), ("small_one", 0.3 / 0.9), ("other", 0.1 / 0.9), ("missing", 0.0)):
        assert abs(got[s].actual_share - want) < 0.02 and abs(got[s].reachable_share - want) < 1e-9
        assert got[s].selected_tokens == sum(r.tokens * r.copies for r in rows if r.source == s)
    assert abs(sum(g.actual_share for g in got.values()) - 1) < 1e-9 and total == sum(g.selected_tokens for g in got.values())
    again = {tuple(r) for r in mix(*frames(spark, docs[::-1], targets), shard_rows=150)[0].collect()}
    assert again == {tuple(r) for r in rows}


def test_empty_and_tokens(spark):
    docs, targets = frames(spark, [], [("big", 1.0, 2)])
    chosen, shares = mix(docs, targets)
    assert chosen.collect() == [] and shares.collect()[0].actual_share == 0.0
    assert mix(*frames(spark, [(1, "a", "x y")], []))[0].collect() == []
    df = spark.createDataFrame([("<|endoftext|> a",), (None,), ("",)], "text string")
    assert [r.tokens for r in count_tokens(df, text="text").collect()][1:] == [0, 0]
    assert count_tokens(df, text="text").collect()[0].tokens > 2
