import random

import pytest

from loomspan.llm import abuse
from loomspan.llm.abuse import ACCEPT, MAX_LABELS, RULES, fit_weights, score
from loomspan.llm.grammar import EDGE, Grammar

# Texts whose rule shares no word with the lexicon of insults.
BY_RULE_ALONE = [
    "I will stab you", "we will murder you", "they should be shot", "he deserves to be lynched", "drink bleach", "jump off a bridge", "go hang yourself", "I hope you drown",
    "you should never have been born", "deport all muslims", "send the migrants home", "faggots", "undress for me", "Verpiss dich!", "Va te faire foutre",
    "I am going to murder you", "gas the jews", "Jews should be banned from here", "those faggots again", "drink bleach please", "You should be executed", "I will slit your throat",
    "Please don't call me names, you are a moron", "I heard you are an idiot",
]
NEGATED = ["I would never hurt you", "I don't think you are an idiot", "nobody thinks he is a moron", "I am not saying you are stupid", "we won't kill you"]


@pytest.mark.parametrize("text", BY_RULE_ALONE)
def test_rules_without_words_of_the_lexicon_are_tried(text):
    assert max(score(text)) >= ACCEPT


@pytest.mark.parametrize("text", NEGATED)
def test_negation_blocks_what_it_governs(text):
    assert max(score(text)) < ACCEPT


def _example(pattern, rng):
    """A walk through one pattern's own machine, from its beginning to its end."""
    one = Grammar(abuse._CLASSES, [pattern])
    words = {s: w for w, s in one.vocabulary.items()} | {s: w for w, s in one._stems.items()}
    end = next(iter(one._final))
    back = [[] for _ in one._arcs]
    for at in range(len(one._arcs)):
        for label, to in [*one._arcs[at], *((None, t) for t in one._free[at])]:
            back[to].append(at)
    near, todo = {end: 0}, [end]  # steps to the end
    for at in todo:
        for b in back[at]:
            if b not in near:
                near[b] = near[at] + 1
                todo.append(b)
    at, said = 0, []
    while at != end:
        ways = [w for w in [*one._arcs[at], *((None, t) for t in one._free[at])] if w[1] in near]
        near_ones = [w for w in ways if near[w[1]] < near[at]]
        label, at = rng.choice(near_ones if len(said) > 6 or rng.random() < 0.5 else ways)
        if label is not None:
            said.append("well" if label == -1 else "#" if label == EDGE else words[label])
    return said


@pytest.mark.parametrize("n", range(len(RULES)))
def test_every_rule_fires_on_examples_of_its_own(n):
    rng = random.Random(n)
    for _ in range(10):
        said = _example(RULES[n][2], rng)
        fired = {r for _, rules in abuse._GRAMMAR.matches([abuse._GRAMMAR.symbol(w) for w in said]) for r in rules}
        assert n in fired, said


def test_a_pattern_is_matched_as_a_backtracking_search_would():
    grammar = Grammar({"YOU": ["you", "u", "you lot"], "INS": ["moron", "piece of shit", "идиот~"]}, ["YOU (are|re) a{0,2} . INS", "# INS+ #", "YOU .* die", "go? home (now|x y)*  z"])

    def found(text):
        return [(at, r) for at, rules in grammar.matches([grammar.symbol(w) for w in text.split()]) for r in rules]

    assert found("you are a big moron") == [(4, 0)]
    assert found("# moron piece of shit #") == [(5, 1)]
    assert found("you lot a b c die") == [(5, 2)]
    assert found("you # die") == []
    assert found("u идиотка re идиоты # moron #") == [(6, 1)]
    assert found("go home now x y z") == [(5, 3)]
    assert found("home x z") == []


def test_weights_from_labels(spark):
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/comment_labels.parquet").select("text_original", "abusive", "hateful", "sexual").orderBy("label_id").collect()]
    wrong = n = 0
    for fold in range(5):  # held out: fitted on the other four
        weights = fit_weights([r for k, r in enumerate(labels) if k % 5 != fold])
        for text, *flags in labels[fold::5]:
            wrong += (max(score(text, weights)) >= ACCEPT) != any(flags)
            n += 1
    assert wrong / n <= 0.04  # about 2 % of the labels are wrong
    low = fit_weights([("you moron", 0, 0, 0)] * 20)
    assert score("you moron", low)[0] < ACCEPT <= score("you moron")[0]
    with pytest.raises(ValueError):
        fit_weights([("", 0, 0, 0)] * (MAX_LABELS + 1))


@pytest.mark.parametrize("unit", ["he said ", "you moron, ", "not (", "in the movie ", "a-", "\n", "was removed "])
def test_long_texts_take_time_in_proportion(unit):
    import time

    from loomspan.llm.privacy import find_spans

    for work in (score, find_spans):
        began = time.perf_counter()
        work(unit * (60_000 // len(unit)) + "1")
        assert time.perf_counter() - began < 10
