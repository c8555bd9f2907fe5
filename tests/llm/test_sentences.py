import random

import pytest

from loomspan.llm.sentences import sentence_starts, sentence_units, sentences

# Sentences are divided by "|" here; the sign itself is taken out.
CASES = [
    "Mr. and Mrs. Zentara tuned it vs. the clock. |It was ... well, good. |Really?! |“Wait. It is late!” was all he said.",
    "She said “Stop. Start over.” and left. |“It is late.” |We met at 5 p.m. sharp. |We end at 9 p.m. |Then we ate.",
    "Prof. A. B. Ridder calls it a “kettle”. |See fig. 16. and fig. 25.) now. |A hand. |50 of 31 takes failed. |iPatch 3.4 is new.",
    "We tune audio.|We start now!|She left. |Visit a.Bc or clip.final.mov, v3.4.4 and http://x.test/A.B?C=1 later.",
    "Am 3. Mai war es z. B. mit Öl. |Das ist ca. 14. Versuch. |Er rief „Halt! Nicht!“ und ging. |„Ist er neu?“ |Der 2. Teil folgt d. h. bald.",
    "« Est-il tordu ? » |Elle a dit « Stop ! On va. » et a ri. |Mme Bell arrive à 9 h. 30. |M. Dela dit : 3,5 kg env. au total.",
    "¿Y el horno? |«Espera. No.» fue todo. |El Sr. Ibar dijo “¡basta!” y se fue. |Eso fue... raro.",
    "他喊了一声「等等！」就跑了。|她说：“停！别动。”然后走了。|“是旧的吗？”|这个嘛……不好说。|重35.7公斤。",
    "「よし！」と叫んだ。|彼は「待って。だめ。」と言った。|「古いですか？」|うーん…難しい。",
    "उसने कहा, “रुको! मत छुओ।” और चली गई। |डॉ. मब ने देखा। |पृष्ठ सं. 6 पर है।",
    "قالت «توقف! لا تلمسه.» ثم خرجت. |«هل هو الثقيل؟» |انظر ص. 25 من الدليل.",
    "Ο κ. Πετρ είπε «Στοπ!» και έφυγε. |Πότε θα ανέβει; |Βίδες κ.λπ. είναι εδώ.",
    "Проф. Петр назвал его «старый мотор». |В 1958 г. он стоил. |Инструменты и т. д. лежат. |Весит 3 кг, т. е. мало.",
    "วันนี้เราลอง |เขาว่า“หยุด!”แล้ววิ่ง |หนัก25.9กิโล",
    "Title here\n\n|Next line\nwraps here. |End\n \n|* one bullet\n|- two. |More\nwrapped\n|• three",
    "(He left. |She stayed.) |Then “unclosed. |Still here.",
    "We left.|Prof. A. B. Ridder came.|Dr. May too.",
    "   |   leading",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    text, want = "", []
    for part in case.split("|"):
        if part.strip():
            want.append(len(text) + len(part) - len(part.lstrip()))
        text += part
    assert sentence_starts(text) == want


def test_pieces_agree_with_whole_texts(spark):
    rnd = random.Random(3)
    texts = [c.replace("|", "") for c in CASES]
    rows = [(n, rnd.choice([" ", "\n", "\n\n", ""]).join(rnd.choices(texts, k=12)), "x") for n in range(40)]
    rows += [(100, "no mark " * 30_000, "x"), (101, ". " * 9000 + "End. Then", "x"), (102, None, "x"), (103, " \n", "x"), (104, "", "x"), (104, "A bee. C dog.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    want = sorted((d, s) for d, t, _ in rows for s in sentence_starts(t))
    for piece in (37, 300, 1 << 18):
        assert sorted(map(tuple, sentences(df, piece=piece).collect())) == want
    units = sentence_units(df.filter("doc_id = 104")).collect()
    assert [(u.sentence_no, u.start_char, u.sentence) for u in units] == [(0, 0, "A bee."), (1, 7, "C dog.")]
    assert sentences(df.limit(0)).collect() == []


@pytest.mark.parametrize("length", [3, 39, 41, 60, 500])
def test_paths_of_any_length_are_no_sentences(length):
    assert sentence_starts("See /docs/" + "a" * length + ".Page for it") == [0]
    assert sentence_starts("word " * 20 + "ended" + "e" * length + ".Then more") == [0, 106 + length]
