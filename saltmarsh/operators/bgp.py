"""Basic graph patterns over triples: inner joins of patterns, optional blocks, unions, negation, projection.

The join order is left to the optimiser, but patterns are joined so that each shares a variable with those before it;
patterns that share none are refused, as they would be a product. The full grammar of a graph query language is out of
scope; the typed views of operators.graph serve most questions with fewer joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]


def match(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of the variables (`?x`) of one pattern; the other terms are constants. A predicate `a/b` is a path of two steps."""
    s, p, o = pattern
    if "/" in p and not p.startswith(("http", "?")):
        first, rest = p.split("/", 1)
        mid = f"?_{abs(hash((s, p, o))) % 10**8}"
        return match(triples, (s, first, mid)).join(match(triples, (mid, rest, o)), mid[1:]).drop(mid[1:])
    t, names = triples, {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if term.startswith("?"):
            names.setdefault(term[1:], []).append(column)
        else:
            t = t.where(F.col(column) == term)
    for columns in names.values():
        for c in columns[1:]:
            t = t.where(F.col(c) == F.col(columns[0]))
    return t.select(*[F.col(c[0]).alias(n) for n, c in names.items()]).distinct()


def _join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in right.columns if c in left.columns]
    if not shared:
        raise ValueError(f"no variable of {right.columns} occurs before; that would be a product")
    return left.join(right, shared, how)


def block(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Bindings of all patterns together."""
    rest = list(patterns)
    out = match(triples, rest.pop(0))
    while rest:
        k = next((i for i, p in enumerate(rest) if any(t.startswith("?") and t[1:] in out.columns for t in p)), 0)
        out = _join(out, match(triples, rest.pop(k)), "inner")
    return out


def select(
    triples: DataFrame, variables: list[str], patterns: list[Pattern], optional: list[list[Pattern]] = (), union: list[list[Pattern]] = (), absent: list[list[Pattern]] = (),
    where: Column | None = None, distinct: bool = True, order: list[str] = (), limit: int | None = None,
) -> DataFrame:
    """SELECT over patterns; each union block must bind the same variables; unbound variables are null."""
    out = block(triples, patterns)
    if union:
        parts = [block(triples, u) for u in union]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p, allowMissingColumns=True)
        out = _join(out, both, "inner")
    for o in optional:
        out = _join(out, block(triples, o), "left")
    for a in absent:
        out = _join(out, block(triples, a), "left_anti")
    if where is not None:
        out = out.where(where)
    out = out.select(*[F.col(v) if v in out.columns else F.lit(None).cast("string").alias(v) for v in variables])
    out = out.distinct() if distinct else out
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)
