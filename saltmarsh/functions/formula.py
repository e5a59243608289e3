"""A scanner for the formulas of salts in running text: formula units, counts, separators and compositions.

A component is a run of symbols (a capital, perhaps a small letter, perhaps a count), perhaps with a multiplier before it
and a mark behind it that a lost count was read as. Components joined by separators make a salt; a composition in
mole per cent may follow.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Marks between components, figures below the line and marks that lost counts are read as.
SEPARATORS, SUBSCRIPTS, LOST = "-·•⋅", "₀₁₂₃₄₅₆₇₈₉", ",."
#: Symbols a component has at most, figures of its multiplier, blanks around a mark.
SYMBOLS, MULTIPLIER, BLANKS = 4, 3, 4


_BEGIN = re.compile("[0-9A-Z]")


class Span(NamedTuple):
    start: int
    end: int
    surface: str


def _is_figure(c: str) -> bool:
    return "0" <= c <= "9"


def _skip(t: str, at: int, most: int = BLANKS) -> int:
    end = min(len(t), at + most)
    while at < end and t[at].isspace():
        at += 1
    return at


def _number(t: str, at: int) -> int:
    """The end of a decimal number that begins at `at`, or `at`."""
    k = at
    while k < len(t) and _is_figure(t[k]):
        k += 1
    if k > at and t[k:k + 1] == "." and k + 1 < len(t) and _is_figure(t[k + 1]):
        k += 2
        while k < len(t) and _is_figure(t[k]):
            k += 1
    return k


def _mark(t: str, at: int, mark: str) -> int:
    """Behind `mark` where it stands at `at` in any case, else `at`."""
    return at + len(mark) if t[at:at + len(mark)].lower() == mark else at


def component(t: str, at: int) -> int:
    """The end of a component that begins at `at`, or `at`."""
    k = at
    while k < len(t) and k - at < MULTIPLIER and _is_figure(t[k]):
        k += 1
    symbols = 0
    while symbols < SYMBOLS and k < len(t) and "A" <= t[k] <= "Z":
        k += 1
        if k < len(t) and "a" <= t[k] <= "z":
            k += 1
        while k < len(t) and (_is_figure(t[k]) or t[k] in SUBSCRIPTS):
            k += 1
        symbols += 1
    if not symbols:
        return at
    return k + 1 if k < len(t) and t[k] in LOST else k


def composition(t: str, at: int) -> tuple[int, list[str]] | None:
    """(end, figures) of a composition such as `(66-34 mol%)` that begins at `at`."""
    k = _skip(t, at + 1) if t[at:at + 1] == "(" else at
    figures = []
    while (end := _number(t, k)) > k:
        figures.append(t[k:end])
        at_mark = _skip(t, end)
        after = _skip(t, at_mark + 1) if t[at_mark:at_mark + 1] == "-" else at_mark
        k = after if after > at_mark and _number(t, after) > after else end
        if k == end:
            break
    if len(figures) < 2:
        return None
    k = _skip(t, k)
    behind = _mark(t, k, "mol")
    if behind == k:
        return None
    k = _skip(t, _mark(t, behind, "."))
    if (e := _mark(t, k, "e")) > k:
        k = _mark(t, e, ".")
    k = _skip(t, k)
    if t[k:k + 1] != "%":
        return None
    k += 1
    closed = _skip(t, k)
    return (closed + 1 if t[closed:closed + 1] == ")" else k), figures


def trailing_composition(t: str) -> tuple[int, list[str]] | None:
    """(start, figures) of a composition at the very end of a text."""
    full = len(t.rstrip())
    for at, c in enumerate(t):
        if c == "(" or _is_figure(c):
            got = composition(t, at)
            if got and got[0] == full:
                return at, got[1]
    return None


def salts(t: str) -> list[Span]:
    """Spans of two or more joined components, with their composition where one follows."""
    out, at = [], 0
    while m := _BEGIN.search(t, at):
        at = m.start()
        last = end = component(t, at)
        while end > at:
            mark = _skip(t, last)
            if t[mark:mark + 1] == "" or t[mark] not in SEPARATORS:
                break
            nxt = _skip(t, mark + 1)
            behind = component(t, nxt)
            if behind == nxt:
                break
            last = behind
        if last > end > at:
            k = last
            while k < len(t) and t[k].isspace():
                k += 1
            if got := composition(t, k):
                last = got[0]
            out.append(Span(at, last, t[at:last]))
            at = last
        else:
            at += 1
    return out


def is_compound(label: str) -> bool:
    """Whether a label is a single component without multiplier and mark."""
    return label[:1].isalpha() and not set(label) & set(SUBSCRIPTS) and label[-1:] not in LOST and component(label, 0) == len(label)
