import pytest

from loomspan.llm.abuse import ACCEPT, score

OUT_OF_REACH = [
    "You are a worthless idiot and this movie sucks", "You said it works, you lying moron", "I heard the noise, you are a pathetic loser", "Great acting, but you are a moron", "You are a worthless idiot for liking this movie",
    "She told me the price and you are a scumbag", "kys, the lyrics are bad", "You are a moron and your video was removed", "go fuck yourself, I reported this",
]
GOVERNED = [
    "He said you are a moron", "He said: you are a moron, you are trash", "You are a moron, he said", "you are a moron she told me", "In this movie, he is a moron", "He is a moron in this movie",
    "Someone wrote you are a worthless idiot and the comment was removed", "Please stop telling people to kill yourself", "don't say you are a loser", "You are a moron, the comment was removed",
]


@pytest.mark.parametrize("text", OUT_OF_REACH)
def test_marks_excuse_no_clause_they_do_not_govern(text):
    assert score(text)[0] >= ACCEPT


@pytest.mark.parametrize("text", GOVERNED)
def test_marks_excuse_the_clause_they_govern(text):
    assert max(score(text)) < ACCEPT
