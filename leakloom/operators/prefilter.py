"""A prefilter for many patterns: one pass over a text tells which rules can match in it.

Of most patterns it can be told beforehand that any match holds one of a few literal strings. All of
these strings, and the keywords that rules state themselves, are looked for at once; only the rules
of which one is there are tried with their pattern. Rules without such strings are always tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _constants as K  # the parsed form of patterns
from re import _parser

import pyarrow as pa

try:
    import ahocorasick
except ImportError:  # each string is then looked for by itself
    ahocorasick = None

#: Characters that a literal has to have, and the most literals that stand for one pattern.
LEAST, MOST = 3, 32
_AROUND = (K.AT, K.ASSERT, K.ASSERT_NOT)
_REPEATS = (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT)


def _product(a: set[str], b: set[str] | None) -> set[str] | None:
    return {x + y for x in a for y in b} if b is not None and len(a) * len(b) <= MOST else None


def _exact(op, arg) -> set[str] | None:
    """All strings that an element matches, in lower case, if they are few and of ASCII."""
    if op is K.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op in _AROUND:
        return {""}
    if op is K.IN:
        found = set()
        for kind, x in arg:
            if kind is K.LITERAL and x < 128:
                found.add(chr(x).lower())
            elif kind is K.RANGE and x[1] < 128 and x[1] - x[0] < MOST:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 4 else None
    if op is K.SUBPATTERN:
        return _all(arg[3])
    if op is K.ATOMIC_GROUP:
        return _all(arg)
    if op is K.BRANCH:
        parts = [_all(x) for x in arg[1]]
        found = set().union(*parts) if None not in parts else None
        return found if found is not None and len(found) <= MOST else None
    if op in _REPEATS and arg[1] <= 4:
        one, out, found = _all(arg[2]), {""}, set()
        for i in range(arg[1] + 1):
            if out is None:
                return None
            if i >= arg[0]:
                found |= out
            out = _product(out, one)
        return found if len(found) <= MOST else None
    return None


def _all(items: Iterable) -> set[str] | None:
    out: set[str] | None = {""}
    for op, arg in items:
        out = _product(out, _exact(op, arg))
        if out is None:
            return None
    return out


def _worth(found: set[str] | None) -> tuple[int, int]:
    return (min(min(map(len, found)), 8), -len(found)) if found else (0, 0)


def _required(items: Iterable, run: set[str]) -> set[str] | None:
    """Strings of which any match of the sequence, after one of run, holds one; of several such sets the best."""
    best = None
    for op, arg in items:
        exact = _exact(op, arg)
        longer = _product(run, exact)
        if longer is not None:
            run = longer
            continue
        inner = None
        if op is K.SUBPATTERN:
            inner = _required(arg[3], run)
        elif op is K.ATOMIC_GROUP:
            inner = _required(arg, run)
        elif op is K.BRANCH:
            parts = [_required(x, run) for x in arg[1]]
            inner = set().union(*parts) if None not in parts else None
        elif op in _REPEATS and arg[0]:
            inner = _required(arg[2], run)
        best = max(best, run, inner if inner and len(inner) <= 2 * MOST else None, key=_worth)
        run = exact if exact is not None else {""}
    return max(best, run, key=_worth)


def literals(pattern: re.Pattern) -> frozenset[str] | None:
    """Strings in lower case of which any text that the pattern matches holds one, once in lower case; None if there are none of use."""
    found = _required(_parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE | pattern.flags & re.ASCII), {""})
    return frozenset(found) if found and min(map(len, found)) >= LEAST else None


class Prefilter:
    """Of rules, given as (keywords, compiled pattern or None), those that can match a text."""

    def __init__(self, rules: Iterable[tuple[Iterable[str], re.Pattern | None]]):
        self.keywords, self.needs, places = [], [], {}
        for keywords, pattern in rules:
            needed = [frozenset(k.lower() for k in keywords if k.isascii())] if all(k.isascii() for k in keywords) else [frozenset()]
            needed.append(literals(pattern) if pattern is not None else None)
            self.keywords.append(tuple(keywords))
            self.needs.append([frozenset(places.setdefault(x, len(places)) for x in n) for n in needed if n])
        self.words, self.found = list(places), None
        if ahocorasick and self.words:
            self.found = ahocorasick.Automaton()
            for x, i in places.items():
                self.found.add_word(x, i)
            self.found.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """The places of the rules to try, in order: those of which a keyword, as written, and a literal are there."""
        low = text.lower()
        held = {i for _, i in self.found.iter(low)} if self.found else {i for i, x in enumerate(self.words) if x in low}
        return [i for i, (words, needs) in enumerate(zip(self.keywords, self.needs, strict=True)) if not any(held.isdisjoint(n) for n in needs) and (not words or any(w in text for w in words))]

    def __getstate__(self) -> dict:  # an automaton is made anew where it is used
        return {"keywords": self.keywords, "needs": self.needs, "words": self.words}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.found = None
        if ahocorasick and self.words:
            self.found = ahocorasick.Automaton()
            for i, x in enumerate(self.words):
                self.found.add_word(x, i)
            self.found.make_automaton()


def candidate_batches(given: Prefilter, ids: list[str]):
    """Of (blob_id, content) the rules to try, as (blob_id, rule_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, rules = [], []
            for blob, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = content.decode("utf-8", "surrogateescape") if isinstance(content, bytes) else content or ""
                found = given.candidates(text)
                blobs += [blob] * len(found)
                rules += [ids[i] for i in found]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(rules, pa.string())], ["blob_id", "rule_id"])

    return run
