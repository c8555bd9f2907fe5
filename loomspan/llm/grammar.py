"""Pattern grammars over words, compiled into one weighted finite automaton."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

#: Symbols that stand for no word of the grammar: the edge of a sentence, a word that a transducer has blocked, any other word.
EDGE, BLOCKED, OTHER = 0, 1, 2
_ANY = -1
_PART = re.compile(r"[()|]|\{\d+,\d+\}|[?*+]|[^\s()|{}?*+]+")


class Grammar:
    """Many patterns as one automaton that reads each word once.

    A pattern is written over words: ``a``, ``stem~`` (words that begin so),
    ``CLASS`` (any phrase of a class), ``.`` (any word), ``#`` (the edge of a
    sentence), ``( | )``, ``?``, ``*``, ``+`` and ``{m,n}``. All patterns are
    joined in a nondeterministic automaton with a final state for each; subsets
    of its states become states of the deterministic one when a text first needs
    them, so a word costs one look-up however many patterns there are. A match
    may begin at any word.
    """

    #: Deterministic states that are kept; beyond, they are built anew.
    KEPT = 50_000

    def __init__(self, classes: Mapping[str, Iterable[str]], patterns: Sequence[str]) -> None:
        self._classes = {name: tuple(phrases) for name, phrases in classes.items()}
        self.vocabulary: dict[str, int] = {"#": EDGE}
        self._stems: dict[str, int] = {}
        self._arcs: list[list[tuple[int, int]]] = []
        self._free: list[list[int]] = []
        self._final: dict[int, int] = {}
        start = self._state()
        for n, pattern in enumerate(patterns):
            parts = _PART.findall(pattern)
            begin, end, rest = self._alternatives(parts, 0)
            if rest != len(parts):
                raise ValueError(f"unbalanced pattern: {pattern}")
            self._free[start].append(begin)
            self._final[end] = n
        for stem, symbol in self._stems.items():  # words of the vocabulary that begin with a stem are read as both
            same = {s for w, s in self.vocabulary.items() if w.startswith(stem) and s > OTHER}
            for arcs in self._arcs:
                arcs += [(s, to) for label, to in list(arcs) if label == symbol for s in same]
        self._lengths = sorted({len(s) for s in self._stems}, reverse=True)
        self._start = frozenset(self._closure({start}))
        self._reset()

    # building

    def _state(self) -> int:
        self._arcs.append([])
        self._free.append([])
        return len(self._arcs) - 1

    def _label(self, word: str) -> int:
        if word == ".":
            return _ANY
        if word == "#":
            return EDGE
        table, key = (self._stems, word[:-1]) if word.endswith("~") else (self.vocabulary, word)
        if key not in table:
            table[key] = OTHER + len(self.vocabulary) + len(self._stems)
        return table[key]

    def _alternatives(self, parts: Sequence[str], at: int) -> tuple[int, int, int]:
        begin, end = self._state(), self._state()
        while True:
            a, b, at = self._sequence(parts, at)
            self._free[begin].append(a)
            self._free[b].append(end)
            if at < len(parts) and parts[at] == "|":
                at += 1
                continue
            return begin, end, at

    def _sequence(self, parts: Sequence[str], at: int) -> tuple[int, int, int]:
        begin = end = self._state()
        while at < len(parts) and parts[at] not in "|)":
            low, high, after = 1, 1, self._skip(parts, at)
            if after < len(parts) and (q := parts[after])[0] in "?*+{":
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(q) or tuple(map(int, q[1:-1].split(",")))
                after += 1
            for n in range(max(low, high or low, 1)):
                a, b = self._item(parts, at)
                self._free[end].append(a)
                if n >= low:
                    self._free[end].append(b)
                end = b
            if high is None:  # the last copy may be repeated, or all left out
                self._free[end].append(a)
                if not low:
                    self._free[a].append(b)
            at = after
        return begin, end, at

    @staticmethod
    def _skip(parts: Sequence[str], at: int) -> int:
        depth = 0
        while True:
            depth += (parts[at] == "(") - (parts[at] == ")")
            at += 1
            if not depth:
                return at

    def _item(self, parts: Sequence[str], at: int) -> tuple[int, int]:
        part = parts[at]
        if part == "(":
            begin, end, _ = self._alternatives(parts, at + 1)
            return begin, end
        begin, end = self._state(), self._state()
        if part.isupper() and len(part) > 1:
            for phrase in self._classes[part]:
                here, words = begin, phrase.split()
                for k, word in enumerate(words):
                    to = end if k == len(words) - 1 else self._state()
                    self._arcs[here].append((self._label(word), to))
                    here = to
        else:
            self._arcs[begin].append((self._label(part), end))
        return begin, end

    # running

    def _closure(self, states: Iterable[int]) -> set[int]:
        found, stack = set(states), list(states)
        while stack:
            for s in self._free[stack.pop()]:
                if s not in found:
                    found.add(s)
                    stack.append(s)
        return found

    def _reset(self) -> None:
        self.rows: list[dict[int, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self._subsets: list[frozenset[int]] = []
        self._numbers: dict[frozenset[int], int] = {}
        self._number(self._start)

    def _number(self, subset: frozenset[int]) -> int:
        n = self._numbers.get(subset)
        if n is None:
            n = self._numbers[subset] = len(self.rows)
            self._subsets.append(subset)
            self.rows.append({})
            self.accepts.append(tuple(sorted({self._final[s] for s in subset if s in self._final})))
        return n

    def step(self, state: int, symbol: int) -> int:
        """The state behind a symbol, built if it is new."""
        if symbol == BLOCKED:
            to = 0
        else:
            reached = {s for at in self._subsets[state] for label, s in self._arcs[at] if label == symbol or label == _ANY and symbol != EDGE}
            to = self._number(frozenset(self._closure(reached)) | self._start)
        self.rows[state][symbol] = to
        return to

    def symbol(self, word: str) -> int:
        """The symbol of a word."""
        found = self.vocabulary.get(word)
        if found is None:
            found = next((self._stems[word[:n]] for n in self._lengths if word[:n] in self._stems), OTHER)
        return found

    def matches(self, symbols: Sequence[int]) -> list[tuple[int, tuple[int, ...]]]:
        """(place, numbers of the patterns) wherever a match ends."""
        if len(self.rows) > self.KEPT:
            self._reset()
        rows, accepts, state, found = self.rows, self.accepts, 0, []
        for at, symbol in enumerate(symbols):
            to = rows[state].get(symbol)
            state = self.step(state, symbol) if to is None else to
            if accepts[state]:
                found.append((at, accepts[state]))
        return found
