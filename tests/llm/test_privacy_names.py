import pytest

from loomspan.llm.privacy import find_spans

NAMES = [
    ("My name is Jessica Miller", "Jessica Miller"), ("ask Kevin Brown about it", "Kevin Brown"), ("me llamo José García Márquez y vivo", "José García Márquez"), ("Ich heiße Jürgen Groß", "Jürgen Groß"),
    ("Jean-Pierre Dupont", "Jean-Pierre Dupont"), ("Anna van Dijk", "Anna van Dijk"), ("Anna SCHMIDT", "Anna SCHMIDT"), ("меня зовут Иван Петров", "Иван Петров"), ("我叫王小明。", "王小明"),
    ("regards, KEVIN BROWN", "KEVIN BROWN"), ("my name is Kevin J. Brown", "Kevin J. Brown"), ("my name is Vincent van Gogh", "Vincent van Gogh"),
]


@pytest.mark.parametrize("text,name", NAMES)
def test_names_outside_the_list_and_of_other_forms(text, name):
    assert [(k, text[a:b]) for a, b, k in find_spans(text)] == [("person_name", name)]


@pytest.mark.parametrize("text", ["ask Verrill Cycles", "contact Verrill Audio Shop", "I AM SO HAPPY", "I am Very Happy", "ask The Host", "I'm Puerto Rican and proud", "Hi, this is Kevin"])
def test_no_names(text):
    assert find_spans(text) == []
