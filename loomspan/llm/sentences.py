"""Sentence boundaries in many languages and scripts, by a finite transducer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.session import materialize

#: Longer documents (characters) are worked in pieces of this size.
PIECE = 1 << 18
#: Characters before a piece, and behind it, that its tokens may look at.
LEFT, RIGHT = 64, 4096

# Words that take a period and go on, whatever follows.
_GOES_ON = frozenset(
    "mr mrs ms mx dr prof pr rev hon sen rep gov pres insp supt gral arq dres gen col capt cpt lt sgt maj cmdr messrs st mt ft sr sra srta dra ud uds vd vds d dña lic ing m mm mme mmes mlle mlles me mgr hr "
    "fr frl dipl vs e.g i.e eg ie cf viz p.ex p.ej ex ej bzw z.b d.h u.a s.o s.u i.d.r sog inkl exkl ggf evtl vgl ca approx aprox env κ κα κος δρ καθ π.χ δηλ т.е напр г-н "
    "проф акад доц инж тов г-жа гр им ул просп डॉ श्री श्रीमती प्रो पं कु सं मि रु मो ई د أ م ص ت هـ ق ج".split()
)
# Words that take a period and a number.
_COUNTS = frozenset(
    "no nos nr nº num núm vol vols fig figs pp p pg pág págs pag art arts sec sect ch chap cap ed eq tab abb bd s st str taf kap z h hs min av abt tel n t pl vgl voir "
    "стр рис гл табл с т ч п ст д кв № σελ εικ αρ τ κεφ पृ पृष्ठ सं अ चित्र ص ج ط م approx aprox ca env circa etwa max jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
# Nouns that German puts after an ordinal number.
_AFTER_ORDINAL = regex.compile(
    r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Teil|Teils|Mal|Male|Folge|Kapitel|Auflage|Ausgabe|Jahrhunderts?|Klasse|Stock|Etage|Platz|Runde|Tag|Woche|Jahr|Geburtstag|Band)\b"
)
# German words that stand before an ordinal number.
_BEFORE_ORDINAL = regex.compile(r"\b(?:ca\.|[Aa]m|[Dd]er|[Dd]ie|[Dd]as|[Dd]em|[Dd]en|[Dd]es|[Zz]um|[Zz]ur|[Bb]eim|[Vv]om|[Ii]m|[Jj]eder|[Ss]ein|[Ii]hr|[Mm]ein|[Uu]nser|[Ee]in)\s$")

_KINDS = ("“”", "„“”", "«»", "‹›", "「」", "『』", '""', "()", "（）", "[]")
_OPENERS = {k[0]: n + 1 for n, k in enumerate(_KINDS)}
_BULLET = r"[*\-•‣◦·▪▫●○■□►▶➤➢✓✔»>+–—]"
_CLOSERS = "”’'」』）)\\]"
_TOKEN = regex.compile(
    rf"(?P<end>[.!?…。！？｡।॥؟۔]+|(?<=[\p{{Greek}}\p{{M}}]);)(?P<close>(?:[ \xa0\u202f]?[»›]|[{_CLOSERS}]|[“\"](?!\p{{L}}))*)(?P<sp>\s*)"
    r"|(?P<line>[^\S\n]*\n\s*)"
    r"|(?P<gap>(?<=[\p{Thai}\p{Lao}])\s+)"
    r"|(?P<mark>[“”„«»‹›「」『』\"()（）\[\]])"
)
_IS_BULLET = regex.compile(_BULLET + r"\s")
_OPEN_RUN = regex.compile(r"[“„«‹「『\"'‘(（\[¿¡\p{Cf}\s]*")
_LEFT = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}.’'№º-]+$")
_QUOTING = regex.compile(r"と|って|[他她它我你您咱]们?(?:\p{Han}{0,3})(?:说|说道|问|问道|喊|喊道|叫道|答|答道|说着)[。，！？]")
_SPEECHLESS = frozenset(",;:-–—·&/%)]}”»›」』、，；：）~=*_|<>")
_STRONG = frozenset("。！？｡।॥؟۔")


def _next_class(text: str, at: int) -> tuple[str, bool]:
    """Of what follows: U upper case, L lower case, C a letter without case, D digit, S sign, N nothing; and whether an opening sign stands first."""
    first = text[at : at + 1]
    p = _OPEN_RUN.match(text, at).end()
    opener = first in _OPENERS
    c = text[p : p + 1]
    if not c:
        return "N", opener
    if c.islower():
        return ("U" if text[p + 1 : p + 2].isupper() else "L"), opener
    if c.isupper() or c.istitle():
        return "U", opener
    if c.isdigit():
        return "D", opener
    if c.isalpha():
        return "C", opener
    return ("L" if c in _SPEECHLESS else "S"), opener


def _period_ends(text: str, at: int, nxt: str, after: int) -> bool:
    """Whether a single period at ``at`` ends a sentence before an upper-case word, a caseless letter, a digit or a sign."""
    left = _LEFT.search(text, max(0, at - 24), at)
    word = regex.sub(r"\p{Cf}+", "", left[0]) if left else ""
    if not word:
        return True
    if glued := regex.search(r"\p{Ll}{2}\.(\p{Lu}[\p{L}\p{M}]*)$", word):
        word = glued[1]  # the word before ended a sentence without a space
    low = word.lower()
    if low in _GOES_ON or low.rpartition(".")[2] in ("ex", "ej") and len(low) < 6:
        return False
    if low in _COUNTS and nxt == "D":
        return False
    last = word.rpartition(".")[2]
    if len(last) == 1 and last.isalpha():
        before = text[max(0, at - len(word) - 4) : at - len(word)]
        if last.isupper():
            return False
        if not last.islower():
            return False
        if "." in word:
            return nxt != "D"
        if regex.search(r"\d\s$", before) and last in "гр":
            return True
        if last in "дп" and regex.search(r"т\.\s?$", before):
            return True
        return False
    if nxt == "U" and word.isdigit() and len(word) <= 3:
        before = _BEFORE_ORDINAL.search(text, max(0, at - len(word) - 12), at - len(word))
        if before or len(word) <= 2 and _AFTER_ORDINAL.match(text, after):
            return False
    return True


class _Compiled:
    """The boundary rules as a table: states by symbols.

    States: 0 at the start of a unit, 1 within one, then for each kind of
    quotation or bracket one where it began the unit and one where it didn't.
    A symbol is what a token is, whatever the state. Actions: bit 1 a boundary
    after the token, 2 a tentative one (it lies within a quotation), 4 drop the
    tentative ones so far, 8 confirm them.
    """

    def __init__(self) -> None:
        self.symbols: dict[tuple, int] = {}
        kinds = range(1, len(_KINDS) + 1)
        keys: list[tuple] = [("reset", o) for o in (False, True)] + [("gap", o) for o in (False, True)] + [("open", k) for k in kinds]
        keys += [("mark", m) for m in {c for k in _KINDS for c in k}]
        closes = sorted({"", *(c for k in _KINDS for c in k[1:])})
        keys += [("end", c, *v) for c in closes for v in product((False, True), repeat=5)]
        n = 2 + 2 * len(_KINDS)
        self.to = np.zeros((n, len(keys)), np.int16)
        self.act = np.zeros((n, len(keys)), np.int16)
        for at, key in enumerate(keys):
            self.symbols[key] = at
            for state in range(n):
                self.to[state, at], self.act[state, at] = self.rule(state, key)
        self.rows = [list(zip(self.to[s].tolist(), self.act[s].tolist())) for s in range(n)]
        self.states = n

    @staticmethod
    def rule(state: int, key: tuple) -> tuple[int, int]:
        inside = state >= 2
        kind, began = (state - 2) // 2, state % 2 == 0
        what = key[0]
        if what == "reset":
            return (0 if key[1] else 1), 1 | (8 if inside else 0)
        if what == "gap":
            return (state, 2) if inside else ((0 if key[1] else 1), 1)
        if what == "open":
            return (state, 0) if inside else (2 * key[1] + (0 if state == 0 else 1), 0)
        if what == "mark":
            mark = key[1]
            if inside:
                return (1, 4) if mark in _KINDS[kind][1:] else (state, 0)
            return (2 * _OPENERS[mark] + (0 if state == 0 else 1), 0) if mark in _OPENERS else (1, 0)
        _, closed, plain, mid, start, opener, reset = key
        onward = 0 if opener else 1
        if inside and closed and closed in _KINDS[kind][1:]:
            if reset:
                return onward, 1 | (8 if began else 4)
            if began:
                return (onward, 8 | 1) if start else (1, 4)
            return (onward, 4 | 1) if mid else (1, 4)
        if reset:
            return onward, 1 | (8 if inside else 0)
        if inside:
            return state, (2 if plain else 0)
        return (onward, 1) if plain else (1, 0)


_RULES = _Compiled()


def _symbols(text: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """(symbol, place just behind the token) of the tokens that begin in text[begin:end]."""
    symbols, size = _RULES.symbols, len(text)
    tokens = _Tokens(text, max(0, begin - LEFT))
    for m in _TOKEN.finditer(text, begin):
        if end is not None and m.start() >= end:
            return
        at = m.end()
        kind = m.lastgroup if m["end"] is None else "end"
        if kind == "mark":
            mark = m[0]
            if mark == '"' and m.start() and text[m.start() - 1].isalnum() and text[at : at + 1].isalnum():
                continue
            yield symbols["mark", mark], at
            continue
        space = m["sp"] if kind == "end" else m[0]
        breaks = space.count("\n")
        reset = breaks > 1 or breaks == 1 and _IS_BULLET.match(text, at) is not None
        if at >= size:
            if kind == "end" and m["close"]:
                yield _end_symbol(m["close"], False, False, True, False, False), -1
            continue
        if kind != "end":
            if reset:
                opener = text[at] in _OPENERS or _IS_BULLET.match(text, at) is not None and text[at + 2 : at + 3] in _OPENERS
                yield symbols["reset", opener], at
            elif kind == "gap" or regex.match(r"[\p{Thai}\p{Lao}]", text[m.start() - 1 : m.start()]):
                yield symbols["gap", text[at] in _OPENERS], at
            continue
        close, ender = m["close"], m["end"]
        if reset:
            opener = text[at] in _OPENERS or text[at + 2 : at + 3] in _OPENERS and _IS_BULLET.match(text, at) is not None
            yield _end_symbol(close, True, True, True, opener, True), at
            continue
        nxt, opener = _next_class(text, at)
        strong = ender[-1] in _STRONG
        if strong:
            plain, mid, start = True, nxt in "UDS", True
        elif not space:
            word = ender in (".", "!", "?") and nxt == "U" and not close and text[at].isupper() and _glued(text, m.start(), at, tokens)
            plain, mid, start = word, False, nxt in "CD" and bool(close)
        else:
            plain = nxt in "UCDS" and (ender != "." or _period_ends(text, m.start(), nxt, at))
            mid, start = plain and nxt in "US", plain
        if start and nxt == "C" and _QUOTING.match(text, at):
            start = False
        yield _end_symbol(close, plain, mid, start, opener, False), at


_ADDRESS_OR_SPACE = regex.compile(r"[\s/@.]")
_WHOLE_RIGHT = regex.compile(r"\S{0,4000}")


class _Tokens:
    """Whether what stands before a place, back to the last white space, looks like an address; each character is looked at once."""

    __slots__ = ("text", "seen", "address")

    def __init__(self, text: str, begin: int) -> None:
        self.text, self.seen, self.address = text, begin, False

    def address_before(self, at: int) -> bool:
        for m in _ADDRESS_OR_SPACE.finditer(self.text, self.seen, at):
            self.address = not m[0].isspace()
        self.seen = max(self.seen, at)
        return self.address


def _glued(text: str, at: int, after: int, tokens: _Tokens) -> bool:
    """A sentence that follows without a space: small letters, the mark, a capitalised word, and no address around it."""
    if tokens.address_before(at) or not regex.search(r"\p{Ll}{2}$|[\p{Ll}]\p{Cf}*\p{Ll}$", text[max(0, at - 40) : at]):
        return False
    return bool(regex.match(r"\p{Lu}(?:\p{L}*[,;:!?’’\"”]?|\p{L}+[-’'.]\S*)$", _WHOLE_RIGHT.match(text, after)[0]))


def _end_symbol(close: str, plain: bool, mid: bool, start: bool, opener: bool, reset: bool) -> int:
    shut = [c for c in close if ("end", c, plain, mid, start, opener, reset) in _RULES.symbols]
    return _RULES.symbols["end", shut[0] if shut else "", plain, mid, start, opener, reset]


def sentence_starts(text: str | None) -> list[int]:
    """Where the sentences of a text begin (code points)."""
    if not text or text.isspace():
        return []
    first = regex.search(r"\S", text).start()
    head = first + 2 if _IS_BULLET.match(text, first) else first
    state = 0 if text[head : head + 1] in _OPENERS else 1
    found, open_ = [first], []
    rows = _RULES.rows
    for symbol, at in _symbols(text, first):
        state, act = rows[state][symbol]
        if act:
            if act & 4:
                open_.clear()
            elif act & 8:
                found += open_
                open_.clear()
            if at > 0:
                if act & 1:
                    found.append(at)
                elif act & 2:
                    open_.append(at)
    found += open_
    return sorted(set(found))


_AFTER_SPACE = regex.compile(r"\s(?=[^\W_])")


def _cuts(text: str, piece: int) -> list[int]:
    """Places to cut a long text, inside no token: before a letter or digit that follows a space; where there is none for long, one that follows a letter or digit."""
    cuts, at = [0], piece
    while at < len(text):
        if m := _AFTER_SPACE.search(text, at, at + RIGHT):
            at = m.end()
        while at < len(text) and not (text[at].isalnum() and (text[at - 1].isspace() or text[at - 1].isalnum())):
            at += 1
        if at < len(text):
            cuts.append(at)
        at += piece
    return cuts


def _pieces(piece: int):
    """Long documents as pieces with the text around them that tokens look at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, key, text in zip(pdf["doc"], pdf["id"], pdf["text"]):
                cuts = _cuts(text, piece)
                for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text)])):
                    left = max(0, a - LEFT)
                    yield pd.DataFrame({"doc": [doc], "id": [key], "piece": [n], "left": [left], "begin": [a - left], "end": [b - left], "last": [b == len(text)], "text": [text[left : b + RIGHT]]})

    return run


def _first_state(text: str, begin: int) -> tuple[int, int]:
    m = regex.compile(r"\S").search(text, begin)
    if m is None:
        return len(text), 1
    head = m.start() + 2 if _IS_BULLET.match(text, m.start()) else m.start()
    return m.start(), 0 if text[head : head + 1] in _OPENERS else 1


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece as the function from the state before it to the state behind it."""
    for pdf in batches:
        maps = []
        for n, begin, end, text in zip(pdf["piece"], pdf["begin"], pdf["end"], pdf["text"]):
            states = np.arange(_RULES.states)
            if n == 0:
                begin, state = _first_state(text, begin)
                states[:] = state
            for symbol, _ in _symbols(text, begin, end):
                states = _RULES.to[states, symbol]
            maps.append(states.astype(np.int32).tolist())
        yield pd.DataFrame({"doc": pdf["doc"], "piece": pdf["piece"], "map": maps})


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before each piece of a document: prefix scan of the pieces' functions, in log2(n) vectorised rounds."""
    pdf = pdf.sort_values("piece")
    maps = np.stack([np.asarray(m) for m in pdf["map"]])
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    before = np.concatenate([[1], maps[:-1, 1]])
    return pd.DataFrame({"doc": pdf["doc"].to_numpy(), "piece": pdf["piece"].to_numpy(), "state": before})


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The actions of each piece from its known first state, numbered in order."""
    for pdf in batches:
        rows = []
        for doc, n, left, begin, end, state, text in zip(*(pdf[c] for c in ("doc", "piece", "left", "begin", "end", "state", "text"))):
            k = 0
            if n == 0:
                begin, state = _first_state(text, begin)
                if begin < len(text):
                    rows.append((doc, n, k, left + begin, 1))
            for symbol, at in _symbols(text, begin, end):
                state, act = _RULES.rows[state][symbol]
                if act:
                    k += 1
                    rows.append((doc, n, k, left + at if at > 0 else -1, act))
        yield pd.DataFrame(rows, columns=["doc", "piece", "k", "at", "act"])


def _short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        starts = [sentence_starts(t) for t in pdf["text"]]
        yield pd.DataFrame({"doc": np.repeat(pdf["doc"].to_numpy(), [len(s) for s in starts]), "start_char": np.concatenate([*starts, []]).astype(np.int32)})


def sentences(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """The sentences of every document: ``doc``, start_char (code points).

    The rules are compiled into one transducer over tokens (end marks with what
    stands around them, line breaks, bullets, quotation marks, spaces after
    scripts without end marks). Boundaries within a quotation are tentative until
    it closes: they are dropped if it stands within a sentence, kept if it
    stands alone or never closes.

    Null and blank texts have no sentence. Equal documents are each reported.
    Other columns are ignored.

    One pass without shuffle, after one that looks for long documents. Documents longer than ``piece`` are cut into
    pieces that are spread over the cluster: each piece becomes the function
    from the state before to the state behind it, the functions are composed by
    a prefix scan, and each piece then emits its boundaries from its own state.
    """
    kind = dict(documents.dtypes)[doc]
    rows = documents.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    short = rows.filter(F.length("text") <= piece).mapInPandas(_short, f"doc {kind}, start_char int")
    starts = _long_starts(_keyed(rows, piece), piece, kind)
    return (short if starts is None else short.unionByName(starts.select(F.col("id").alias("doc"), "start_char"))).withColumnRenamed("doc", doc)


def _keyed(rows: DataFrame, piece: int) -> DataFrame:
    """Long documents, each row with a key of its own as doc and its name as id, which may be null or repeated."""
    return rows.filter(F.length("text") > piece).select(F.monotonically_increasing_id().alias("doc"), F.col("doc").alias("id"), "text")


def _long_starts(rows: DataFrame, piece: int, kind: str) -> DataFrame | None:
    """doc, id, start_char of the sentences of keyed rows, by a prefix scan over their pieces; null if there are no rows."""
    cut = rows.mapInPandas(_pieces(piece), f"doc long, id {kind}, piece int, left long, begin int, end int, last boolean, text string")
    cut = materialize(cut.repartition("doc", "piece"))  # the pieces of long documents alone, read three times below
    if cut.isEmpty():
        return None
    states = cut.mapInPandas(_functions, "doc long, piece int, map array<int>").groupBy("doc").applyInPandas(_scan, "doc long, piece int, state int")
    acts = cut.drop("id").join(states, ["doc", "piece"]).mapInPandas(_emit, "doc long, piece int, k int, at long, act int")
    ahead = Window.partitionBy("doc").orderBy("piece", "k").rowsBetween(1, Window.unboundedFollowing)
    settled = F.when(F.col("act").bitwiseAND(12) != 0, F.col("act").bitwiseAND(12))
    acts = acts.withColumn("fate", F.first(settled, ignorenulls=True).over(ahead))
    kept = (F.col("act").bitwiseAND(1) != 0) | (F.col("act").bitwiseAND(2) != 0) & (F.coalesce("fate", F.lit(8)) == 8)
    starts = acts.filter(kept & (F.col("at") >= 0)).select("doc", F.col("at").cast("int").alias("start_char")).distinct()
    return starts.join(cut.filter("piece = 0").select("doc", "id"), "doc")


def sentence_units(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Each sentence with its number, place and text without outer whitespace. Documents longer than ``piece`` are divided as in sentences()."""

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t, starts in zip(pdf["doc"], pdf["text"], pdf["starts"] if "starts" in pdf else map(sentence_starts, pdf["text"])):
                rows += [(d, n, a, t[a:b].rstrip()) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(t)]))]
            yield pd.DataFrame(rows, columns=["doc", "sentence_no", "start_char", "sentence"])

    kind = dict(documents.dtypes)[doc]
    result = f"doc {kind}, sentence_no int, start_char int, sentence string"
    rows = documents.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    out = rows.filter(F.length("text") <= piece).mapInPandas(units, result)
    long_ = materialize(_keyed(rows, piece))  # so that keys stay the same
    starts = _long_starts(long_, piece, kind)
    if starts is not None:
        packed = starts.groupBy("doc").agg(F.sort_array(F.collect_list("start_char")).alias("starts"))
        out = out.unionByName(long_.join(packed, "doc").select(F.col("id").alias("doc"), "text", "starts").mapInPandas(units, result))
    return out.withColumnRenamed("doc", doc)
