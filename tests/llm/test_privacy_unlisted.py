"""Names outside the list of given names, in the places where people leave names."""

import pytest

from loomspan.llm.privacy import GIVEN_NAMES, find_spans

NAMES = [
    ("Oluwaseun", "Adeyemi"), ("Gunther", "Baumgartner"), ("Hiroshi", "Tanaka"), ("Siobhan", "O'Malley"), ("Jonathan", "Miller"), ("Kathleen", "Brown"), ("Matthew", "Kowalczyk"), ("Wiremu", "Parata"),
    ("Anneliese", "Schreiber"), ("Thabo", "Nkosi"), ("Bartholomew", "King"), ("Guadalupe", "Hernandez"), ("Svetlana", "Morozova"), ("Ngozi", "Okafor"), ("Étienne", "Lefèvre"), ("Jürgen", "Weiß"),
]
PLACES = {
    "text": [
        "my neighbour {} has the same one", "Bought mine off {} last year, still runs", "Bought it from {} in Varrow", "please ask {} about it", "Is that {} behind the counter?", "thanks for all\nregards, {}", "my dentist {} says hi",
        "{} here, I built the first one", "Say hello to {} for me", "credit goes to {} not to you", "hola, soy {} y vivo cerca", "my name is {}", "Made the plans for this ({})", "Mr. {} taught me that", "I learned it from {}, a fine smith",
    ],
    "display": ["{}"],
}
STRANGERS = [
    "Velvet Kettle", "Northern Signal", "Ostrander Radio Club", "Okonweze Woodworks", "Cedar Orchard", "Lucky Harbour", "Is that the Wexcombe Bridge at 5:13?", "Greetings from Lindle Bay!", "Lake Castellov looks lovely",
    "My Zentara burner does the same", "The Mbalari museum in Port Tallow has one.", "Thanks Sofia, very clear.", "hi Hana and Sofia, love the show", "Which Brindle model?", "Viele Zuschauer fragten nach dem Hobel.",
    "thank you so much", "ask me about it", "I am very happy here", "(fast forward)", "is that the New York edition?", "Bought it from Home Depot last year", "soy muy feliz aquí",
]


def recall(texts, spell):
    found = total = 0
    for given, family in NAMES:
        name = spell(given, family)
        for place in texts:
            text = place.format(name) if name != name.upper() else place.upper().format(name) if "{}" in place.upper() else place
            at = text.index(name)
            total += 1
            found += any(a == at and b == at + len(name) and kind == "person_name" for a, b, kind in find_spans(text))
    return found / total


@pytest.mark.parametrize(
    "where,least,spell",
    [
        ("text", 0.9, lambda g, f: f"{g} {f}"), ("display", 0.9, lambda g, f: f"{g} {f}"), ("text", 0.9, lambda g, f: f"{g.upper()} {f.upper()}"),
        ("text", 0.6, lambda g, f: f"{f}, {g}"), ("text", 0.3, lambda g, f: f"{g.lower()} {f.lower()}"),
    ],
)
def test_recall_of_names_outside_the_list(where, least, spell):
    assert not {g.lower() for g, _ in NAMES} & GIVEN_NAMES
    got = recall(PLACES[where], spell)
    print(where, spell("Given", "Family"), round(got, 3))
    assert got >= least


@pytest.mark.parametrize("text", STRANGERS)
def test_no_names(text):
    assert [text[a:b] for a, b, kind in find_spans(text) if kind == "person_name"] == []
