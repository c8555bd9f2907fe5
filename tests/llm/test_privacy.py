import pytest

from loomspan.llm.privacy import find_personal_information, find_spans, luhn, mod97, redact, redact_text

FOUND = [
    ("Mail me at nadia.mbalari@example.net please", [("email", "nadia.mbalari@example.net")]),
    ("x, Mail me at greta dot hollis-teague at example dot com please", [("email", "greta dot hollis-teague at example dot com")]),
    ("write to quillon[at]example[.]com or a.b (at) post (dot) test", [("email", "quillon[at]example[.]com"), ("email", "a.b (at) post (dot) test")]),
    ("@turbo contact: r.o @ post.test", [("email", "r.o @ post.test")]),
    ("Call me on +49 30 23125121 after six", [("phone", "+49 30 23125121")]),
    ("my number: 555-555-0163 ring 07700900227 (evenings)", [("phone", "555-555-0163"), ("phone", "07700900227")]),
    ("text +1 (555) 555-0139", [("phone", "+1 (555) 555-0139")]),
    ("call five five five zero one eight four", [("phone", "five five five zero one eight four")]),
    ("llámame al 001.555.555.0194", [("phone", "001.555.555.0194")]),
    ("My social security no. is 933-12-1985 and", [("id_number", "933-12-1985")]),
    ("tax number GB66 FAKE 6930 2113 3003 79 was rejected", [("id_number", "GB66 FAKE 6930 2113 3003 79")]),
    ("paid with 4111 1111 1111 1111 today", [("id_number", "4111 1111 1111 1111")]),
    ("ID 97096993T on the receipt", [("id_number", "97096993T")]),
    ("IBAN GB82 WEST 1234 5698 7654 32", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
    ("we meet at 148 alder row on Sunday", [("street_address", "148 alder row")]),
    ("parcel went to 30, rue du Moulin, Hemmelin by mistake", [("street_address", "30, rue du Moulin, Hemmelin")]),
    ("vivo en Calle del Pozo 98, Ketterby", [("street_address", "Calle del Pozo 98, Ketterby")]),
    ("Kesselgasse 16, 04198 Varrow", [("street_address", "Kesselgasse 16, 04198 Varrow")]),
    ("my dentist Rosa Mbalari says hi", [("person_name", "Rosa Mbalari")]),
    ("regards, Dunmarrow, Aisha", [("person_name", "Dunmarrow, Aisha")]),
    ("BRUNO OSTRANDER here, I built", [("person_name", "BRUNO OSTRANDER")]),
    ("ask priya achterby about it, they know", [("person_name", "priya achterby")]),
    ("hola, soy Tomas J. Morrowby y vivo cerca", [("person_name", "Tomas J. Morrowby")]),
    ("Mateo Grumholt", [("person_name", "Mateo Grumholt")]),
]
NOTHING = [
    "Order 10018-2761 never shipped, avoid Kessop.", "ISBN 0-000-5069-X has it on page 9.", "Part no. 44-94-B fits", "Server 192.0.2.52 was down",
    "Sold 19 of these on 2024-02-13 alone.", "The 1995 handbook says 15.8 mm, not 29.2.", "This deserves 466,453 more views.", "At 88:68 scale", "firmware v7.4.0 broke",
    "Is that the Haldorsun Bridge at 5:21?", "The Nakarada museum in Varrow", "Lake Okonweze looks lovely", "hi Kofi and Sofia, love the show", "Thanks Samir, very clear.",
    "The old Elm Lane episode", "@KofiQuillon", "Verrill Cycles", "Rosa Woodworks", "@host you", "Take a look at dot four on the dial", "HI HUGO AND JONAS, LOVE THE SHOW", "Bruno", "", None,
]


@pytest.mark.parametrize("text,want", FOUND)
def test_found(text, want):
    assert [(k, text[a:b]) for a, b, k in find_spans(text)] == want


@pytest.mark.parametrize("text", NOTHING)
def test_nothing(text):
    assert find_spans(text) == []


def test_checks_and_placeholders():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB83WEST12345698765432")
    assert redact_text("ask Rosa Mbalari at r@x.test.") == "ask [NAME] at [EMAIL]."
    assert redact_text(None) is None and redact_text("plain") == "plain"


def test_frames(spark):
    rows = [("a", "😀 (555) 555 0145", "Rosa Mbalari", "k"), ("a", "😀 (555) 555 0145", "Rosa Mbalari", "k"), ("b", None, "", "k"), ("c", "word " * 30_000 + "x@y.test", None, "k")]
    df = spark.createDataFrame(rows, "id string, text string, author string, field string")
    got = sorted(map(tuple, find_personal_information(df, key="id", fields=["text", "author"]).collect()))
    assert got == [("a", "author", "person_name", 0)] * 2 + [("a", "text", "phone", 3)] * 2 + [("c", "text", "email", 150_000)]
    clean = redact(df, key="id", fields=["text", "author"]).collect()
    assert clean[0].text == "😀 [PHONE]" and clean[0].author == "[NAME]" and clean[2].text is None
    assert find_personal_information(df.limit(0), key="id", fields=["text"]).collect() == []


@pytest.mark.parametrize("part", ["1234567890 ", "1", "a@b ", "12 Some ", "12 a b ", "a dot ", "AB12 ", "x1", "five ", "Rosa Mbalari ", "Speaker 1: "])
def test_long_texts_take_time_in_proportion(part):
    import time

    began = time.perf_counter()
    find_spans(part * (60_000 // len(part)))
    assert time.perf_counter() - began < 8
