import random

import numpy as np
import pytest

from loomspan.llm import leakage
from loomspan.llm.leakage import leaked_spans, winnow, words


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, item_id string, pos int"),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string"),
    )


def brute(docs, items, span=12):
    grams = lambda t: {tuple(w[n : n + span]) for w in [words(t or "")] for n in range(len(w) - span + 1)}
    return {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


@pytest.mark.parametrize("bound", [10**6, 0])
def test_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(leakage, "BROADCAST_FINGERPRINTS", bound)
    rnd = random.Random(5)
    vocabulary = ["ash", "birch", "cork", "Döner", "Elm", "fir"]
    items = [(n, " ".join(rnd.choices(vocabulary, k=rnd.choice([5, 12, 30])))) for n in range(20)] + [(50, None), (51, ""), (None, "a " * 40)]
    docs = []
    for n in range(60):
        w = words(rnd.choice(items)[1] or "")
        cut = rnd.randrange(10, 14)
        at = rnd.randrange(max(1, len(w) - cut + 1))
        middle = rnd.choice([", ", "\n", " -- "]).join(w[at : at + cut])
        docs.append((n, f"x{n} {middle.upper()} y{n} " + " ".join(rnd.choices(vocabulary, k=8))))
    docs += [(90, None), (91, ""), (92, docs[3][1]), (93, "long " * 60_000 + docs[4][1]), (None, docs[4][1])]
    got = leaked_spans(*frames(spark, docs, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute([d for d in docs if d[0] is not None], [i for i in items if i[0] is not None])
    for r in got:
        d, i = words(dict(docs)[r.doc_id]), words(dict(items)[r.item_id])
        assert d[r.doc_word : r.doc_word + r.n_words] == i[r.item_word : r.item_word + r.n_words] and r.n_words >= 12


def test_normalisation_and_empty(spark):
    assert words("The CAFÉ’s—so­da, na​ïve ＡＢ 1.5") == ["the", "cafe", "s", "soda", "naive", "ab", "1", "5"]
    assert leaked_spans(*frames(spark, [], [])).collect() == []
    assert leaked_spans(*frames(spark, [(1, "a b")], [])).collect() == []


def test_winnowing_guarantee():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        shared = rnd.integers(0, 4, 12).astype(np.uint64)
        a = np.concatenate([rnd.integers(0, 4, rnd.integers(0, 20)).astype(np.uint64), shared, rnd.integers(0, 4, rnd.integers(0, 20)).astype(np.uint64)])
        b = np.concatenate([rnd.integers(0, 4, rnd.integers(0, 20)).astype(np.uint64), shared])
        prints = [set(winnow(x, np.array([len(x)]))[1].tolist()) for x in (a, b)]
        assert prints[0] & prints[1]
