import pytest

from loomspan.llm.privacy import find_spans

ADDRESSES = [
    "12 quai de la Loire", "12 bd Voltaire", "5 impasse des Lilas", "8 cours Mirabeau", "Kerkstraat 12", "Storgatan 5", "c/ Mayor 15", "avda. Libertad 22", "corso Italia 12",
    "carrera Septima 45", "３０ rue du Moulin",
]


@pytest.mark.parametrize("text", ADDRESSES)
def test_every_form_of_address(text):
    assert [(k, text[a:b]) for a, b, k in find_spans(text)] == [("street_address", text)]


@pytest.mark.parametrize("text", ["8 cours of work", "5 cours de yoga", "3 route options", "una carrera de 10 km", "mi carrera en 2020"])
def test_other_meanings_of_street_words(text):
    assert find_spans(text) == []


def test_digits_of_any_script():
    assert [k for _, _, k in find_spans("it is ٠٧٧٠٠ ٩٠٠٢٢٧, call me on ٠٧٧٠٠٩٠٠٢٢٧")][-1:] == ["phone"]
    assert [k for _, _, k in find_spans("call me on +４９ ３０ ２３１２５１２１ after six")] == ["phone"]
