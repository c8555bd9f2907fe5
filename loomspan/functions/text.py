"""Scalar functions over text, as Column expressions that stay in whole-stage code."""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace in the Unicode sense, in a form that Java and RE2 both read.
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SENTENCE_END = rf"[.!?]+[{SPACE}]+|[.!?]+$"
WORD = r"[A-Za-z']+"
URL = r"https?://\S+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
TIMESTAMP = r"\b(?:\d{1,2}:)?\d{1,2}:\d{2}\b"
#: Two or more capitalised words after a word that doesn't end a sentence: names of people, places, works.
ENTITY = r"[^.!?\s][ ]([A-Z][a-z]+(?: [A-Z][a-z]+)+)"

# Lengths in characters, and the points of a text of that length.
EFFORT = ((60, -5), (80, -4), (100, -3), (120, -2), (140, -1), (160, 0), (200, 1), (300, 2), (400, 3), (500, 4), (600, 5))
# Phrases that cite.
CITATIONS = ("according to", "see also", "as described in", "as noted in", "cited in", "referenced in")
# Discourse markers.
DISCOURSE = (
    r"i\.?e\.?", r"e\.?g\.?", "namely", "specifically", "in particular", "in other words", "in essence", "for example", "for instance", "such as", "however", "moreover", "furthermore",
    "nevertheless", "therefore", "thus", "hence", "including but not limited to", "by contrast", "by definition", "as a matter of", "in nature", "fundamentally",
)
SPECIAL_SIGNS = ';—–/_"'
# Median and 99th percentile of each measure of technical writing.
TECHNICAL = {"word_length": (4.59, 5.23), "sentence_length": (22.0, 51.0), "discourse_markers": (0.0, 3.0), "special_signs": (0.0, 0.0194)}
TECHNICAL_MOST = 2.5
TECHNICAL_LENGTH = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


def sentence_pieces(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: ~is_blank(s))


def sentence_count(text: Column) -> Column:
    """Pieces between end marks, 1 at least; 0 for blank text."""
    return F.when(is_blank(text), 0).otherwise(F.greatest(F.lit(1), F.size(sentence_pieces(text)))).cast("bigint")


def type_token_ratio(text: Column) -> Column:
    return let(found(F.lower(text), r"[a-z']+"), lambda words: ratio(F.size(F.array_distinct(words)), F.size(words)))


def caps_ratio(text: Column) -> Column:
    return ratio(count(text, r"\p{Lu}"), count(text, r"\p{L}"))


def emoji_density(text: Column) -> Column:
    return ratio(count(text, EMOJI), F.length(text))


def punctuation_ratio(text: Column) -> Column:
    return ratio(count(text, r"\p{P}"), F.length(text))


def mid_sentence_caps_ratio(text: Column) -> Column:
    """Capitalised words that don't begin a sentence, among all words; 0 under 30 characters. Sentences end by rule, not by model."""
    def share(tokens: Column) -> Column:
        later = F.transform(tokens, lambda t: F.size(F.filter(t, lambda w, i: (i > 0) & w.rlike("^[A-Z][a-z]"))))
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        return ratio(total(later), total(F.transform(tokens, F.size)))

    return F.when(F.length(text) < 30, 0.0).otherwise(let(F.transform(sentence_pieces(text), lambda s: found(s, r"\p{L}+")), share))


def structural_features(text: Column) -> Column:
    return F.struct(
        F.length(text).cast("bigint").alias("length"), sentence_count(text).alias("sentence_count"), type_token_ratio(text).alias("type_token_ratio"), caps_ratio(text).alias("caps_ratio"),
        emoji_density(text).alias("emoji_density"), punctuation_ratio(text).alias("punctuation_ratio"), mid_sentence_caps_ratio(text).alias("mid_sentence_caps_ratio"),
    )


def has_url(text: Column) -> Column:
    return text.rlike(URL)


def has_citation(text: Column) -> Column:
    return F.lower(text).rlike("|".join(CITATIONS))


def entities(text: Column) -> Column:
    """Names by rule; a model can be plugged in as a pandas UDF (see loomspan.functions.providers)."""
    return F.regexp_extract_all(text, F.lit(ENTITY), 1)


def timestamps(text: Column) -> Column:
    """(seconds, text) of every [H:]M:SS with fewer than 60 seconds, in order."""
    hits = F.transform(found(text, TIMESTAMP), lambda m: F.struct(F.split(m, ":").alias("p"), m.alias("m")))
    good = F.filter(hits, lambda h: F.element_at(h["p"], -1).cast("int") < 60)
    seconds = lambda p: F.aggregate(p, F.lit(0), lambda t, x: t * 60 + x.cast("int"))
    return F.transform(good, lambda h: F.struct(seconds(h["p"]).alias("seconds"), h["m"].alias("text")))


def effort_table() -> list[float]:
    """Points by length from the first anchor to the last, rounded as binary values are."""
    points: list[float] = []
    for (a, low), (b, high) in pairwise(EFFORT):
        points += [round(low + (n - a) / (b - a) * (high - low), 1) for n in range(a, b)]
    return [*points, float(EFFORT[-1][1])]


def effort_points(length: Column) -> Column:
    """Points for a text's length: linear between the anchors, to one decimal; flat outside."""
    first, last = EFFORT[0][0], EFFORT[-1][0]
    table = F.array(*(F.lit(p) for p in effort_table()))
    return F.element_at(table, (F.least(F.greatest(length, F.lit(first)), F.lit(last)) - first + 1).cast("int"))


def quadratic(value: Column, low: float, high: float) -> Column:
    """0 up to ``low``, the most from ``high`` on, the square of the way between."""
    t = (value - low) / (high - low)
    return F.when(value <= low, 0.0).when(value >= high, TECHNICAL_MOST).otherwise(TECHNICAL_MOST * t * t)


def technicality(text: Column) -> Column:
    """Points of four measures of technical writing, each rounded to one decimal; all 0 for short texts."""
    none = F.struct(*(F.lit(0.0).alias(k) for k in TECHNICAL))

    def points(m: Column) -> Column:
        return F.when((m["sentences"] >= 1) & (m["n"] > 0), F.struct(*(F.round(quadratic(v, *TECHNICAL[k]), 1).alias(k) for k, v in raw(m).items()))).otherwise(none)

    def raw(m: Column) -> dict[str, Column]:
        return {"word_length": m["letters"] / m["n"], "sentence_length": m["n"] / m["sentences"], "discourse_markers": m["markers"], "special_signs": m["signs"] / F.length(text)}

    measures = let(
        found(text, WORD),
        lambda words: F.struct(
            F.size(words).alias("n"), F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).alias("letters"), sentence_count(text).alias("sentences"),
            count(text, r"(?i)\b(?:" + "|".join(DISCOURSE) + r")\b").alias("markers"), count(text, f"[{SPECIAL_SIGNS}]").alias("signs"),
        ),
    )
    return F.when(F.length(text) >= TECHNICAL_LENGTH, let(measures, points)).otherwise(none)


def caps_step(ratio_: Column) -> Column:
    """From 2 % capitalised words on a point a percent, 5 at most."""
    return let(F.floor(ratio_ * 100), lambda percent: F.when(percent >= 2, F.least(F.lit(5), percent - 1)).otherwise(0)).cast("double")


def sentence_bonus(n: Column) -> Column:
    return let(n, lambda k: F.when(k >= 2, F.least(F.lit(5.0), 0.5 * k)).otherwise(0.0))


def is_anti(text: Column) -> Column:
    """Shouting, mostly emoji, or nothing but addresses."""
    bare = F.regexp_replace(text, URL, "")
    return (caps_ratio(text) > 0.5) & (F.length(text) > 10) | (emoji_density(text) > 0.2) | is_blank(bare) & (F.length(text) > 0)


def is_mention(text: Column) -> Column:
    """Begins with @, after spaces or invisible characters."""
    return text.rlike(rf"^[{SPACE}\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]*@")


def display_length(line: Column) -> Column:
    """Length in which an address counts 20 characters at most."""
    over = F.aggregate(found(line, URL), F.lit(0), lambda a, u: a + F.greatest(F.lit(0), F.length(u) - 20))
    return (F.length(line) - over).cast("bigint")


def has_link(text: Column) -> Column:
    return text.rlike(r"https?://|@[\p{L}\p{N}_]")


def has_line_time(text: Column) -> Column:
    return text.rlike(r"(?:^|\n)\d{1,2}:\d{2}")


def is_hashtags(text: Column) -> Column:
    return strip(text).rlike(r"^#\S+(?:\s+#\S+)*$")


def is_separator(text: Column) -> Column:
    """No ASCII letter or digit; true for the empty string."""
    return ~text.rlike(r"[a-zA-Z0-9]")


def grep(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def botlike_reasons(handle: Column) -> Column:
    """Why a handle looks generated; an empty array if it doesn't."""
    letters = F.regexp_replace(handle, r"[^\p{L}]", "")
    vowels = count(F.lower(letters), "[aeiou]")
    return F.array_compact(
        F.array(
            F.when(handle.rlike(r"[0-9]{5,}"), "long digit run").when(handle.rlike(r"[0-9]{4}[A-Za-z]"), "digits inside"),
            F.when(F.lower(handle).rlike(r"[bcdfghjklmnpqrstvwxz]{5,}"), "consonant cluster"),
            F.when((F.length(letters) >= 6) & (vowels / F.length(letters) < 0.2), "few vowels"),
        )
    )
