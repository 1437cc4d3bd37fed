"""Boolean trigram queries derived from regular expressions.

``trigram_query`` reads a pattern's syntax tree and returns, in disjunctive
form, trigrams that every match must contain (in lower case): a set of
clauses, each a set of trigrams; a text without all trigrams of any clause
cannot match.  ``None`` means that no trigram is mandatory.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser

MAX_STRINGS = 64
Clauses = frozenset[frozenset[str]]


def trigrams_of(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any_of(strings: set[str]) -> Clauses | None:
    """Clauses that say: one of these strings occurs."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _smallest({trigrams_of(s) for s in strings})


def _smallest(clauses: set[frozenset[str]]) -> Clauses:
    """Without clauses that hold all trigrams of another."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses | None, b: Clauses | None) -> Clauses | None:
    if a is None or b is None:
        return a if b is None else b
    if len(a) * len(b) > MAX_STRINGS:
        return min(a, b, key=len)  # either is true of every match
    return _smallest({x | y for x in a for y in b})


def _set_of(items) -> set[str] | None:
    chars: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            chars.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 8:
            chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return chars if len(chars) <= 8 else None


def _read(node) -> tuple[set[str] | None, Clauses | None]:
    """All strings that a sequence can match, if few; else clauses true of its matches."""
    current: set[str] = {""}
    clauses: Clauses | None = None
    whole = True
    for op, value in node:
        strings, inner = _read_one(op, value)
        if strings is not None and len(strings) * len(current) <= MAX_STRINGS:
            current = {a + b for a in current for b in strings}
            continue
        whole = False
        clauses = _both(_both(clauses, _any_of(current)), inner if strings is None else _any_of(strings))
        current = {""}
    if whole:
        return current, None
    return None, _both(clauses, _any_of(current))


def _read_one(op, value) -> tuple[set[str] | None, Clauses | None]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, None
    if op is sre.IN:
        return _set_of(value), None
    if op is sre.SUBPATTERN:
        return _read(value[3])
    if op is sre.BRANCH:
        read = [_read(x) for x in value[1]]
        if all(s is not None for s, _ in read):
            return set().union(*[s for s, _ in read]), None
        parts = [_any_of(s) if s is not None else c for s, c in read]
        return None, None if any(c is None for c in parts) else _smallest(set().union(*parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, clauses = _read(inner)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), None
        if strings is not None and least == most and len(strings) == 1 and least <= 16:
            return {next(iter(strings)) * least}, None
        if least == 0:
            return None, None
        return None, _any_of(strings) if strings is not None else clauses
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> Clauses | None:
    """Clauses of mandatory trigrams of a pattern, or None if it has none."""
    strings, clauses = _read(parser.parse(pattern, re.NOFLAG))
    return _any_of(strings) if strings is not None else clauses
