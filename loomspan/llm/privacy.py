"""Personal information in free text: spans proposed by patterns, confirmed by checks and by words nearby."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
#: A span is reported from this score on.
ACCEPT = 2.0
#: Characters before and after a span in which words count.
NEAR = 34
#: A public tokenizer: words that are single tokens of it in small letters are common words, and so seldom given names.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Given names the proposer of person names knows.
GIVEN_NAMES = frozenset(
    "aaron abdul adam adriana agnes ahmed aisha akira alan albert alejandro alex alexander alice amina amir ana andrea andreas andrew angela anna anne anton antonio "
    "arjun arthur astrid barbara beatriz ben benjamin birgit boris bruno carla carlos carmen caroline catherine cecilia charles chen chloe christine claire clara claudia "
    "daniel david deepak diana diego dmitri dorothy edward elena elias elif elizabeth emeka emil emily emma eric erik eva fatima felix fiona francesca frank freya gabriel george "
    "giulia grace greta hana hannah hans hassan heidi helen helena henry hugo ibrahim igor ines ingrid irina isabel ivan jack jakob james jana javier jean jennifer jin john "
    "jonas jorge jose joseph juan julia julian karen karin katarina katya kenji kofi kwame lars laura leila lena leo linda lisa lucas lucia luca luis magnus malik mara marco margaret maria "
    "marie mark marta martin mary mateo matteo max mehmet mei michael mia miguel mohammed monica nadia natasha nina nora oleg olga olivia omar oscar oskar pablo patrick paul "
    "pavel pedro peter petra priya rachel rafael raj ravi rebecca richard robert rosa ruth samir samuel sandra sarah simon sofia sophie stefan susan sven tariq thomas tomas "
    "ursula vera victor viktor wei william yara yuki yusuf zeynep zoe".split()
)
# Words that don't follow a given name as a family name.
_NOT_FAMILY = frozenset(
    "a about after again all also always am an and are as asked at back be because been before behind but by calls came can could did do does done down even ever every "
    "film filmed first for from gave get gets got had has have he hello help helped here hey hi his how i if in is it its just knows let like looks love loved loves made makes me "
    "mentioned more my near never next no not now of off often on one or our out over please pls really right said saw says she should showed so still take takes talks "
    "tells than thank thanks that the their them then there they this thought to told too tried try tries under uploaded und up us used uses very video videos vs was we well went were "
    "what when where which while who why will with would wrote y yes yet you your et le la los las el de del en es por para con que si ne ist der die das mit für".split()
)
# Words that begin sentences, which may follow a name without a mark between.
_NOT_FAMILY |= frozenset(
    "say ask mail call text phone ring good great nice best quick best around sold source order part server source timestamps first greetings subscribed honestly agreed same visible hot burn someone another only everyone "
    "everybody imagine nobody people watch these those any some see holy dead dumb lake old bought credit hola regards pick parcel send vivo whatsapp anfragen escríbeme llámame meine pinned haha lol keep go going come "
    "show start stop look looking sounds works work made making using used need needs want wants wish hope wait waiting maybe perhaps since until although though however whoever whenever wherever each both few many "
    "much most other such own than too yeah sure amazing awesome love loving lovely beautiful sorry anyone anything something nothing today tomorrow yesterday tonight".split()
)
# Words that make the capitalised words before them a thing or place.
_THING = frozenset(
    "bridge museum lake street st lane road rd avenue ave row close way drive square park river valley hill mountain island bay harbour harbor station school university college library "
    "theatre theater hotel cafe café bar shop store club radio studio studios woodworks works cycles motors audio media films records kit model version edition manual handbook channel show podcast "
    "episode series foundation institute hall tower church castle garden gardens market festival award prize company co inc ltd gmbh llc brothers sons method theorem effect number museum's "
    "workshop garage tools instruments bikes crafts kitchen bakery gallery press news tv online official reviews repairs restorations orchard meadow pantry attic cedar maple willow pottery collective academy "
    "society united city county team gaming vlog tutorials daily academy orchestra band ensemble farm ranch forge foundry mill woods forest creek beach port fort mount cape bay quay hollow puerto rio lago monte isla villa bad sankt saint".split()
)
# Common words that are common family names too.
_COMMON_FAMILY = frozenset(
    "brown white black green grey gray young king hill wood woods cook baker smith walker hall wright carter turner parker cooper bell ward cox price long foster fisher hunter hunt marsh rice stone fox rose "
    "west north park wolf archer mason porter potter page pope cross day field fields frost gold may moon noble pike reed rich sharp short steel strong sweet waters webb wise little day love bird brooks banks knight bishop "
    "butler carpenter shepherd singer weaver miller silva costa santos cruz diaz lee kim park chen wang li khan singh".split()
)
_PLACE_BEFORE = re.compile(r"(?:\b(?:in|from|near|to|at|of|visit|lake|mount|the|via|à|en|nach|aus|bei)\s+|[@#/_.-])$", re.I)
_SALUTE = frozenset("hi hello hey thanks thank dear yes no sorry please great nice well so and ok okay agreed good cheers bye wow lol then but because also first congrats bravo source".split())
_NAME_BEFORE = re.compile(
    r"(?:\b(?:ask|neighbou?r|dentist|doctor|teacher|boss|friend|cousin|uncle|aunt|brother|sister|colleague|hello to|goes to|credit|credits|from|off|behind|regards|sincerely|soy|me llamo|je suis|ich bin|"
    r"heiße|heisse|my name is|name is|name's|i am|i'm|this is|mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|by|met|with|called|is that|was|it's|signed|contact|attn|c/o|landlord|mechanic|wife|husband|son|daughter)[,:]?\s*|[(~–—-]\s?)$",
    re.I,
)
_NAME_AFTER = re.compile(r"^(?:[,)]|\s*(?:here|says|about it|has the|said|behind|last year|for me|not to you|y vivo|lives|built|knows|told|will|works|sold|from|in \p{Lu}|$))".replace(r"\p{Lu}", "[A-Z]"), re.I)
# Words that introduce a person by name, whatever the name; behind the weaker ones more must speak of a person.
_INTRODUCED = re.compile(
    r"(?<![\w'’])(?:(?P<strong>(?i:ask|(?:my|our|his|her|their|your) (?:neighbou?r|dentist|doctor|teacher|boss|friend|cousin|uncle|aunt|brother|sister|colleague|landlord|mechanic|wife|husband|son|daughter|coach|nurse|lawyer|manager|student|tutor|partner|roommate|classmate)|(?:my|his|her|their|whose) name is|my name[’']s|"
    r"regards|sincerely|cheers|yours|me llamo|mi nombre es|je m[’']appelle|mon nom est|ich hei(?:ß|ss)e|mein name ist|mi chiamo|meu nome é|меня зовут|signed|attn|c/o|contact|mrs?\.?|ms\.?|dr\.?|prof\.?|hola,? soy))"
    r"|(?P<weak>(?i:hello to|greetings to|shout ?-?out to|hi to|credits? (?:goes |go )?to|credits?|thanks to|thank you|thanks|is that|was that|isn't that|hey|hi|hello|dear|love to|named|called|met|"
    r"(?:bought|got|ordered|learned|heard|borrowed|have|had|had|one|it|this|mine|these|them) (?:it |this |mine |one |these |them |that )?(?:from|off|by)|(?:written|made|built|filmed|painted|taught|signed|sold|sent|played|designed|restored|composed|edited|read) by|with|by)"
    r"|(?P<am>I am|i am|I['’]m|i['’]m|soy|Soy|je suis|Je suis|ich bin|Ich bin|this is|This is)))[,:]?\s+(?=[^\W\d_])"
)
# A name at the beginning of a sentence, by what follows it; in parentheses; and as the last line.
_OPENING = re.compile(r"(?:^|[.!?…\n])\s{0,8}(?=[^\W\d_])")
_SPEAKS = re.compile(r"\s(?:here\b[,.!]?|says\b|said\b|told\b|taught\b|from \w+ here|speaking\b|wrote\b|built\b|knows?\b|lives?\b|sold\b|owes?\b)", re.I)
_ENCLOSED = re.compile(r"(?:\((?=[^\W\d_])|(?:^|\n|[.!?]\s)\s{0,8}[-–—~]\s?(?=[^\W\d_]))")
_FOLLOWED = re.compile(
    r"(?:[,)]|\s*(?:here|says|about it|has the|said|behind|last (?:year|week|month|summer)|for me|for us|not to you|y vivo|lives|built|knows|told|will|works|sold|from|in [A-Z]|IN|if|who|and (?:he|she|they)|gave|showed|taught|made|next door|at the|$))", re.I
)
_CJK_NAME = re.compile(r"(?:我叫|我的名字[是叫]|名前は|名は)\s*(?P<name>[\u4e00-\u9fff]{2,4})(?=です|と申|[^\u3040-\u30ff\u4e00-\u9fff]|$)")
_PARTICLE = re.compile(r"(?:van(?: de[rn]?)?|von(?: de[rmn])?|de la|de las|de los|di|da|dos|das|bin|ibn|al|el|ter|ten) ")

_AT = r"(?:@| @ |\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|＠)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?| dot )"
_LOCAL = r"[^\W_][\w.+-]{0,64}(?: dot [\w.+-]{1,64}|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?[\w.+-]{1,64}){0,4}"
_EMAIL = re.compile(rf"(?<![\w.+@-])(?P<local>{_LOCAL}){_AT}(?P<domain>[^\W_][\w-]{{0,63}}(?:{_DOT}[\w-]{{1,63}}){{1,6}})", re.I)
_EMAIL_WORDS = re.compile(r"(?<![\w.+@-])[^\W_][\w.+-]{0,64}(?: dot [\w.+-]{1,64}){0,4} at (?P<domain>[^\W_][\w-]{0,63}(?:(?:\.| dot )[\w-]{1,63}){1,6})(?![\w-])(?!\s?[\[({@]|\sat\s)", re.I)
_EMAIL_HINT = re.compile(r"@|＠|\bdot\b|[\[({]\s?at\s?[\])}]", re.I)
# Ends of addresses that are accepted where the at sign is written out or set apart.
_TLD = frozenset("com net org example test invalid edu gov io info biz co me tv app dev eu us uk de fr es it nl be ch at pl ru cn jp in br mx ca au se no dk fi pt gr tr ar cl xyz online site".split())

_SPELLED = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve)"
_PHONE_WORDS = re.compile(rf"\b{_SPELLED}(?:[\s,-]+(?:double |triple )?{_SPELLED}){{6,14}}\b", re.I)
_DIGITS = re.compile(r"(?<![\w.,:/#=&?-])(?<![A-Za-z]\s)?[+(]{0,2}\d[\d ().\-/‐-–\xa0]{5,24}\d(?![\w])(?![.,:/-]\d)")
_PHONE_NEAR = re.compile(r"\b(?:call|phone|ring|text|whats ?app|number|nummer|tel|telephone|mobile|cell|handy|fax|sms|dial|reach|llama|llámame|teléfono|número|appelle|numéro|contact|old one was)\b", re.I)
_PHONE_AFTER = re.compile(r"^\W*(?:ask for|\(?evenings|after (?:six|five|seven|work)|if you still|but try|only\b|anytime|mornings|weekdays)", re.I)
_NOT_NUMBER = re.compile(r"(?:isbn|issn|order|part no\.?|part|server|no\.|nr\.?|version|ver\.?|rev\.?|firmware|model|serial|invoice|ticket|tracking|sku|item|ip|build|page|pages|sold|score|ratio|#)\s*:?\s*(?:no\.?\s*)?$", re.I)
_DATE = re.compile(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d|(?:19|20)\d\d\s?[-–]\s?(?:19|20)\d\d)$")
_IP = re.compile(r"^\d{1,3}(?:\.\d{1,3}){3}$")

_ID_SHAPES = (
    ("iban", 1.5, re.compile(r"\b(?:[A-Z]{2}\d{2}(?:[ -]?[A-Z]{4})?(?:[ -]?(?=[A-Z]*\d)[A-Z0-9]{4}){2,7}(?:[ -]?\d{1,3})?|[a-z]{2}\d{2}(?:[ -]?[a-z]{4})?(?:[ -]?\d{4}){2,7}(?:[ -]?\d{1,3})?)\b")),
    ("nino", 1.5, re.compile(r"\b[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]\b", re.I)),
    ("card", 0.5, re.compile(r"(?<![\w+.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])")),
    ("ssn", 1.0, re.compile(r"(?<![\w+.(-])\d{3}([ -])\d{2}\1\d{4}(?![\w-])")),
    ("dni", 1.0, re.compile(r"\b(?:\d{8}|[XYZ]\d{7})[ -]?[A-HJ-NP-TV-Z]\b", re.I)),
    ("ten", 0.5, re.compile(r"(?<![\w+.(-])(?:\d{4} \d{3} \d{3}|\d{3} \d{3} \d{4}|\d{3} \d{3} \d{3}|\d{2} \d{3} \d{3} \d{3}|\d{4} \d{4} \d{4})(?![\w-])")),
    ("document", 0.5, re.compile(r"\b(?!ID|NO|NR|TO|IS|MY|AT|ON|IN)[A-Z]{1,2}[ -]?\d{6,9}[A-Z]?\b", re.I)),
    ("plain", 0.0, re.compile(r"(?<![\w+.,:/#-])\d{8,12}(?![\w-])(?![.,:]\d)")),
)
_ID_NEAR = re.compile(
    r"\b(?:social security|tax|national insurance|insurance number|passport|documento|dni|nie|nif|id|identity|account|iban|konto|kontonummer|cuenta|ssn|nhs|licen[cs]e|steuer\w*|ausweis\w*|pasaporte|passeport|reisepass|sécurité sociale|"
    r"compte|bank|card|karte|tarjeta|sort code|aadhaar|pesel|personalausweis|visa|green card|patient)\b",
    re.I,
)
_ID_AFTER = re.compile(r"^\W*(?:on the (?:form|receipt)|was rejected|can you believe|if you want to chip|and it still failed)", re.I)

_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|close|row|way|drive|dr|boulevard|blvd|court|ct|square|sq|place|pl|terrace|crescent|mews|grove|walk|parade|highway|hwy|gardens|alley)"
_NUMBER = r"(?<![\w.,:/#-])\d{1,4}(?:\s?[a-h])?(?:\s?[-/–]\s?\d{1,4})?"
_ADDRESSES = (
    re.compile(rf"{_NUMBER},?\s+(?P<words>(?:[^\W\d_][\w'’.-]*\s+){{1,3}}){_STREET}\b\.?", re.I),
    re.compile(rf"{_NUMBER}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|bd|place|allée|allee|chemin|impasse|quai|route|cours|passage|square)\s+(?:(?:de la|de l['’]|du|des|de|d['’]|la|le|les)\s*)?[^\W\d_][\w'’-]*(?:\s+[A-Z][\w'’-]*)?", re.I),
    re.compile(r"\b(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carrera|via|viale|piazza|corso|rua|ulica|ul\.)\s+(?:[^\W\d_][\w'’.-]*\s+){1,4}?(?:,\s*)?(?:n[º°.o]\.?\s*)?\d{1,4}(?:\s?[a-h])?\b(?![:.]\d)", re.I),
    re.compile(r"\b[^\W\d_][\w-]{2,60}?(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer|steig|chaussee|straat|laan|gatan|vägen|vej)\s+\d{1,4}(?:\s?[a-h])?\b(?![:.]\d)", re.I),
    re.compile(r"\b(?:ул\.|улица|пр\.|проспект|пер\.)\s*[^\W\d_][\w -]*?,?\s*(?:д\.\s*)?\d{1,4}[а-я]?\b", re.I),
)
# Words for streets that are also words for other things: only a name in capitals after them makes an address.
_STREET_OR_NOT = re.compile(r"\b(?i:cours|route|passage|carrera|corso)\s+(?:(?i:de la|de l['’]|du|des|de|d['’]|la|le|les)\s*)?(?P<name>\S)")
_ADDRESS_REST = re.compile(r"(?:,\s*(?:[Ff]lat|[Aa]pt\.?|[Uu]nit|[Ss]uite|#)\s?\w+)?(?:,\s*\d{4,5}(?=\s+[A-Z]))?(?:,?\s*(?<=[,\d] )[A-Z][a-z]+(?: (?:Bay|Quay|Hollow|Tallow|Town|City))?\b)?")
# Small words that don't stand in the name of a street whose words are in small letters.
_NOT_STREET = frozenset("the of on in my his her a an to and by this that long half at for with is was it more times minutes hours days coins screws views percent years per each no all one other wrong right only".split())

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W_]")
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> bool:
    """The check of payment cards: doubled every other digit from the right, the sum ends in 0."""
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of international bank accounts: the rearranged number leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in (code[4:] + code[:4]).upper())) % 97 == 1


def _id_check(shape: str, text: str) -> bool:
    code = re.sub(r"[ -]", "", text)
    if shape == "iban":
        return mod97(code)
    if shape in ("card", "plain"):
        return len(code) >= 13 and luhn(code)
    if shape == "dni":
        n = int({"X": "0", "Y": "1", "Z": "2"}.get(code[0].upper(), code[0]) + code[1:-1])
        return "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23] == code[-1].upper()
    if shape == "ten" and len(code) == 10:
        return (11 - sum(int(c) * w for c, w in zip(code, range(10, 1, -1))) % 11) % 11 == int(code[-1])
    return False


def _emails(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _EMAIL.finditer(text):
        last = re.split(r"[^\w]+", m["domain"])[-1].lower()
        plain = text[m.end("local")] == "@"
        if last.isalpha() and len(last) > 1 and (plain or last in _TLD):
            local = m["local"]
            start = m.start()
            skip = re.search(r"(?:.*\sat\s)", local)
            yield (start + (skip.end() if skip else 0), m.end(), 3.0)
    for m in _EMAIL_WORDS.finditer(text):
        if re.split(r"[\W]+", m["domain"])[-1].lower() in _TLD:
            yield m.start(), m.end(), 3.0


def _ids(text: str) -> Iterator[tuple[int, int, float]]:
    for shape, base, pattern in _ID_SHAPES:
        for m in pattern.finditer(text):
            code = m[0]
            digits = sum(c.isdigit() for c in code)
            if digits < 6 or shape in ("iban", "document", "nino", "dni") and _mixed(code):
                continue
            before, after = text[max(0, m.start() - NEAR) : m.start()], text[m.end() : m.end() + NEAR]
            score = base + 2 * _id_check(shape, code)
            if _ID_NEAR.search(before) or _ID_AFTER.search(after):
                score += 2
            if _NOT_NUMBER.search(before) or _DATE.match(code) or shape == "plain" and _PHONE_NEAR.search(before):
                score -= 3
            yield m.start(), m.end(), score


def _mixed(code: str) -> bool:
    """Small and capital letters together: words, not a code."""
    letters = [c for c in code if c.isalpha()]
    return any(c.islower() for c in letters) and any(c.isupper() for c in letters)


def _phones(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _DIGITS.finditer(text):
        start, code = m.start(), m[0]
        for part in re.finditer(r"[+(]{0,2}\d(?:[\d().\-/‐-–]|[ \xa0](?=[\d(]))*\d", code):
            yield from _phone(text, start + part.start(), part[0])
    for m in _PHONE_WORDS.finditer(text):
        yield m.start(), m.end(), 1.0 + 2 * bool(_PHONE_NEAR.search(text[max(0, m.start() - NEAR) : m.start()])) + (m[0].count(" ") >= 6)


def _phone(text: str, at: int, code: str) -> Iterator[tuple[int, int, float]]:
    digits = "".join(str(int(c)) for c in re.sub(r"\D", "", code))  # of any script
    groups = re.findall(r"\d+", code)
    if not 7 <= len(digits) <= 15 or _DATE.match(code) or _IP.match(code) or max(map(len, groups)) < 2 or len(groups) > 7:
        return
    before, after = text[max(0, at - NEAR) : at], text[at + len(code) : at + len(code) + NEAR]
    score = 0.0
    if code[0] == "+":
        score += 2.5
    elif digits.startswith("00") and len(digits) >= 10:
        score += 1.5
    elif digits[0] == "0" and len(digits) in (9, 10, 11, 12):
        score += 1.5
    if "(" in code:
        score += 1
    if [len(g) for g in groups[-3:]] == [3, 3, 4]:
        score += 1.5
    if _PHONE_NEAR.search(before):
        score += 2
    if _PHONE_AFTER.search(after):
        score += 1
    if code == text.strip():
        score += 1
    if _NOT_NUMBER.search(before):
        score -= 4
    yield at, at + len(code), score


def _addresses(text: str) -> Iterator[tuple[int, int, float]]:
    for n, pattern in enumerate(_ADDRESSES):
        for m in pattern.finditer(text):
            if n == 0:
                words = m["words"].split()
                small = [w for w in words if w[0].islower()]
                if {w.lower() for w in words} & _NOT_STREET or small and (len(small) < len(words) or len(words) > 2):
                    continue
            elif (unsure := _STREET_OR_NOT.search(m[0])) and not unsure["name"].isupper():
                continue
            rest = _ADDRESS_REST.match(text, m.end())
            yield m.start(), rest.end() if rest else m.end(), 2.5


def _names(text: str) -> Iterator[tuple[int, int, float]]:
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    for n, (a, b, word) in enumerate(words):
        if not _given(word):
            continue
        if _shape(word) == "title" and (m := _PARTICLE.match(text, b + 1)) and text[b] == " " and (last := _WORD.match(text, m.end())) and _shape(last[0]) == "title" and _family(last[0]):
            score = _name_score(text, a, last.end(), word, last[0], None)
            if score:
                yield a, last.end(), score
        if n + 1 < len(words):
            k = n + 1
            if len(words[k][2]) == 1 and k + 1 < len(words) and text[b : words[k][0]] == " " and text[words[k][1] : words[k + 1][0]] in (". ", " "):
                k += 1  # a middle initial
            c, d, family = words[k]
            if k > n + 1 or text[b:c] in (" ", "\xa0"):
                score = _name_score(text, a, d, word, family, words[k + 1] if k + 1 < len(words) else None)
                if score:
                    yield a, d, score
        if n:
            c, d, family = words[n - 1]
            comma = text[d:a] == ", "
            if comma or text[d:a] == " ":
                score = _reversed_score(text, c, b, family, word, words, n, comma)
                if score:
                    yield c, b, score


def _given(word: str) -> bool:
    """A known given name, or several with hyphens that begin with one."""
    parts = word.lower().split("-")
    return parts[0] in GIVEN_NAMES and (len(parts) == 1 or all(p[:1].isupper() for p in word.split("-")))


@lru_cache(4)
def _common_words(path: str) -> frozenset[str]:
    """Words in small letters that are single tokens of a public byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        return frozenset(t[1:] for t in json.load(f)["model"]["vocab"] if t[0] == "\u0120" and len(t) > 2 and t[1:].isalpha() and t[1:].islower())


def _name_at(text: str, at: int) -> tuple[int, list[str], str, bool] | None:
    """(end, words, shape, whether the family comes first) of two to four words that may be a person's name; particles and initials aside."""
    words: list[str] = []
    end, shape, comma = at, None, False
    while len(words) < 4 and (word := _WORD.match(text, at)):
        found, low = _shape(word[0]), word[0].lower()
        if not (len(word[0]) == 1 and word[0].isupper() and len(words) == 1):  # an initial
            if found == "other" or low in _NOT_FAMILY or low in _SALUTE or len(low) < 2:
                break
            if shape is not None and found != shape and (shape, found) != ("title", "upper"):
                break
            if low in _THING:
                return None
            words.append(word[0])
            shape, end = shape or found, word.end()
            if shape != "title" and len(words) == 2:
                break
        at = word.end() + (len(word[0]) == 1 and text[word.end() : word.end() + 1] == ".")
        if len(words) == 1 and text[at : at + 2] == ", " and not comma:
            comma, at = True, at + 2
            continue
        if text[at : at + 1] not in (" ", "\xa0") or comma:
            break
        at += 1
        if particle := _PARTICLE.match(text, at):
            at = particle.end()
    if len(words) < 2 or text[end : end + 1] in ("@", "_"):
        return None
    return end, words, shape, comma


def _evident(text: str, common: frozenset[str]) -> Iterator[tuple[int, int, float]]:
    """Names whatever they are, from what stands around them and from their words being rare.

    The words around a name, its shape and its rarity each add to its score; a
    name in small or capital letters throughout needs them all.
    """

    def rate(at: int, context: float, alone: bool = False, strong: bool = False) -> tuple[int, int, float] | None:
        name = _name_at(text, at)
        if name is None:
            return None
        end, words, shape, comma = name
        given, family = (words[1], words[0]) if comma else (words[0], words[-1])
        given, family = given.lower().split("-")[0], family.lower()
        rare = given not in common and given not in _COMMON_FAMILY or given in GIVEN_NAMES
        whole = rare and (family not in common or family in _COMMON_FAMILY)
        if not whole and not (strong and shape == "title" and not comma):
            return None
        after = bool(_FOLLOWED.match(text, end)) and not alone
        if comma and not (strong or alone or after):
            return None
        score = {"title": 1.0, "upper": 0.5, "lower": 0.0}[shape] + context + 1.0 * after + 0.5 * rare
        if shape == "lower" and not (after and (strong or context >= 1.0)):
            return None
        return at, end, score

    for m in _INTRODUCED.finditer(text):
        strong = m["strong"] is not None
        if found := rate(m.end(), 1.5 if strong else 0.25 if m["am"] else 0.5, strong=strong):
            yield found
    for m in _OPENING.finditer(text):
        name = _name_at(text, m.end())
        if name and _SPEAKS.match(text, name[0]) and (found := rate(m.end(), 0.5)):
            yield found
    for m in _ENCLOSED.finditer(text):
        name = _name_at(text, m.end())
        if name and name[2] != "lower" and (text[name[0] : name[0] + 1] == ")" or text[m.end() - 1] != "(" and not text[name[0] :].strip()) and (found := rate(m.end(), 1.0)):
            yield found
    if len(text) < 60 and (m := _LEADING.match(text)) and (name := _name_at(text, m.end())) and not text[name[0] :].strip(" .\u200b"):
        if name[2] == "title" and (found := rate(m.end(), 0.5, alone=True)):
            yield found
    for m in _CJK_NAME.finditer(text):
        yield m.start("name"), m.end("name"), 2.5


_LEADING = re.compile(r"[\s\u200b]*(?=[^\W\d_])")


def _shape(word: str) -> str:
    if word.isupper() and len(word) > 1:
        return "upper"
    if word[0].isupper() and any(c.islower() for c in word):
        return "title"
    return "lower" if word.islower() else "other"


def _family(word: str) -> bool:
    low = word.lower()
    return len(low) > 2 and low not in _NOT_FAMILY and low not in _SALUTE and low not in GIVEN_NAMES


def _name_score(text: str, start: int, end: int, given: str, family: str, after_word) -> float:
    shape = _shape(given)
    unequal = (shape, _shape(family)) == ("title", "upper")  # Anna SCHMIDT
    if shape != _shape(family) and not unequal or shape == "other" or not _family(family):
        return 0.0
    if start and text[start - 1] in "@#/_" or text[end : end + 1] in ("@", "_"):
        return 0.0
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    if family.lower() in _THING or after_word and after_word[0] - end <= 1 and after_word[2].lower() in _THING and shape == _shape(after_word[2]):
        return 0.0
    score = {"title": 2.0, "upper": 1.0, "lower": 0.5}[shape] - 0.5 * unequal
    score += 1.5 * bool(_NAME_BEFORE.search(before)) + 1.0 * bool(_NAME_AFTER.search(after))
    if not before.strip() or before.endswith(("\n", ". ", "! ", "? ")):
        score += 0.5
    if len(family) >= 5 and shape != "title":
        score += 0.5
    return score


def _reversed_score(text: str, start: int, end: int, family: str, given: str, words: list, n: int, comma: bool) -> float:
    shape = _shape(given)
    if shape != _shape(family) or shape == "other" or not _family(family) or family.lower() in _THING:
        return 0.0
    if start and text[start - 1] in "@#/_" or text[end : end + 1] in ("@", "_"):
        return 0.0
    if n + 1 < len(words) and text[end : words[n + 1][0]] == " " and _shape(words[n + 1][2]) == shape and _family(words[n + 1][2]) and words[n + 1][2].lower() not in _THING:
        return 0.0
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    score = {"title": 1.0, "upper": 0.5, "lower": 0.0}[shape]
    named = bool(_NAME_BEFORE.search(before))
    if not named and _PLACE_BEFORE.search(before):
        return 0.0
    score += 1.5 * named + 1.0 * bool(_NAME_AFTER.search(after))
    if comma and not before.strip() and not after.strip():
        score += 1.0
    if not comma:
        score -= 0.5
        if n > 1 and text[words[n - 2][1] : start] == " " and _shape(words[n - 2][2]) == shape == "title" and not named:
            return 0.0
    return score


def find_spans(text: str | None, vocabulary: str = VOCABULARY) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of personal information in a text, in order and without overlap.

    Kinds are looked for in the order of KINDS; what an item covers is no
    longer open to the next kind. Null and empty texts have none.
    """
    if not text:
        return []
    digit = _DIGIT.search(text) is not None
    taken: list[tuple[int, int, str]] = []  # in order

    def take(kind: str, spans: Iterator[tuple[int, int, float]]) -> None:
        long_first = kind == "id_number"
        for a, b, _ in sorted((s for s in spans if s[2] >= ACCEPT), key=lambda s: ((s[0] - s[1], -s[2]) if long_first else (-s[2], s[0] - s[1]))):
            at = bisect_left(taken, (a, b, kind))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                taken.insert(at, (a, b, kind))

    if _EMAIL_HINT.search(text):
        take("email", _emails(text))
    if digit:
        take("id_number", _ids(text))
        take("phone", _phones(text))
        take("street_address", _addresses(text))
    elif _PHONE_WORDS.search(text):
        take("phone", _phones(text))
    known = any(not GIVEN_NAMES.isdisjoint(w.split("-")) for w in _WORD.findall(text.lower()))
    take("person_name", chain(_names(text) if known else (), _evident(text, _common_words(vocabulary))))
    return taken


def redact_text(text: str | None, vocabulary: str = VOCABULARY) -> str | None:
    """The text with each item replaced by the placeholder of its kind."""
    out, at = [], 0
    for a, b, kind in find_spans(text, vocabulary):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return text if not out else "".join([*out, text[at:]])


def find_personal_information(df: DataFrame, *, key: str, fields: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Every item of personal information: ``key``, field, kind, start_char.

    start_char is the place (code points) of the item's first letter or digit.
    Patterns propose spans; check digits (Luhn, mod 97, mod 23, mod 11) and the
    shape of a span give a score, words near it raise or lower it, and spans from
    ACCEPT on are kept. Numbers without a sound check digit are kept only
    where words near them name a document or account. Given names alone,
    handles, and names that are part of a place, brand or channel are no items.

    Null and empty texts give none; whole texts are read, however long; rows
    that are repeated are each reported; other columns are ignored. One pass,
    without shuffle.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field in fields:
                for k, text in zip(pdf[key], pdf[field]):
                    for a, b, what in find_spans(text, vocabulary):
                        rows.append((k, field, what, _LETTER.search(text, a).start()))
            yield pd.DataFrame(rows, columns=[key, "field", "kind", "start_char"])

    return df.select(key, *fields).mapInPandas(run, f"`{key}` {kind}, field string, kind string, start_char int")


def redact(df: DataFrame, *, key: str, fields: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and the fields with each item replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME]; null stays null."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, vocabulary), na_action="ignore")

    return df.select(key, *(cleaned(f).alias(f) for f in fields))
