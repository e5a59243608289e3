"""Problem 4: several values packed into one field, one value a row with its place.

Delimiters are inferred per source. A source writes in several dialects: a dialect is the set of separators that a field
holds outside quotes and exponents. For every source, field and dialect each candidate delimiter set is scored by what
it makes of all records of that dialect: the share of records whose pieces are of one regular type (numbers of one
notation, names, balance words, empty places) times the share whose piece count is consistent with the companion field.
A record takes the delimiter set its source's score favours, unless its own pieces or its own count speak against it.

Judgements depend only on the signature of a text (words, figures and quoted values each stand for their kind), so a
task works out each signature once, and one pass gives the partial sums of all scores.

A field may be delimited by any one separator, any two, all it holds, or all but the comma of decimal numbers.

Defined results: a null, blank or `n/a` field and a field of one value give no rows; an empty place keeps its number
and gives no row; quotes around a value go, doubled quotes inside become single, an unclosed quote is an ordinary
character; repeated records give one set of rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators that are tried (fixed values).
SEPARATORS = "-–/+;,|:·\t"
#: Texts that stand for no value (fixed values).
MISSING = {"", "n/a", "na", "none", "-"}
#: Words that join the two ends of a range (fixed values).
JOINING = {"to", "from", "and", "bis", "through"}
#: A record departs from its source's habit with this probability; what irregular pieces and a disagreeing count weigh.
DEPARTS, IRREGULAR, DISAGREES = 0.05, 1e-4, 1e-2
#: Scores (rows a source, field, dialect and delimiter set) that are sent to every worker; beyond, they are joined by source.
MOST_SCORES = 200_000
#: Texts and signatures a task remembers.
MOST_HELD = 100_000

_NUM = r"\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?"
_NUMBER = re.compile(rf"{_NUM}\s*%?\Z")
_NAME = re.compile(r"[^\W\d_][\w .()*]*\Z")
#: Stand for a shielded value that is a name, a number, a number with a decimal comma.
_V, _N, _C = "\ue001", "\ue002", "\ue003"
_SHIELDED = re.compile(f"[{_V}-{_C}]")
_SHIELD = re.compile(rf'''(?<![^\W_])"((?:[^"]|"")*)"(?!["\w])|(?<![^\W_])'((?:[^']|'')*)'(?!['\w])|(\d+(?:[.,]\d+)?[eE][+-]\d+)|([{_V}-{_C}])''')
_NEEDS_SHIELD = re.compile(rf"[\"'{_V}-{_C}]|\d[eE][+-]")
_LEXEME = re.compile(r"[^\W\d_][\w.()*]*|\d+")


def _shield(text: str) -> tuple[str, list[str]]:
    """text with each quoted value and exponent replaced by one character of its kind, and the values in order."""
    if not _NEEDS_SHIELD.search(text):
        return text, []
    held: list[str] = []

    def keep(m: re.Match) -> str:
        v = m[1].replace('""', '"') if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[0]
        held.append(v)
        return (_C if "," in v else _N) if m[3] or m[4] is None and _NUMBER.match(v) else _V

    return _SHIELD.sub(keep, text), held


class _Lexemes(dict):
    """What stands for a word or a figure in a signature; of bounded size."""

    def __missing__(self, w: str) -> str:
        if len(self) > MOST_HELD:
            self.clear()
        low = w.lower()
        got = self[w] = "9" if w[0].isdigit() else low if low in JOINING else "b" if w.islower() and w.isalpha() else "A"
        return got


def _kind(p: str) -> str:
    """n(umber), c (number with a decimal comma), v (name), b(alance), e(mpty) or x of a shielded piece."""
    if not p:
        return "e"
    if len(p) == 1 and _V <= p <= _C:
        return "vnc"[ord(p) - 0xE001]
    if _SHIELDED.search(p):
        return "x"
    if _NUMBER.match(p):
        return "c" if "," in p else "n"
    if p.islower() and p.isalpha():
        return "b"
    return "v" if _NAME.match(p) else "x"


@lru_cache(4096)
def _cutter(seps: str):
    return (lambda body: (body,)) if not seps else (lambda body: body.split(seps)) if len(seps) == 1 else re.compile(f"[{re.escape(seps)}]").split


def _pieces(body: str, seps: str) -> list[str]:
    """The pieces of a shielded text; the ends of a range written with words are pieces of their own."""
    out = []
    for raw in _cutter(seps)(body):
        p = raw.strip()
        if " " in p or "\xa0" in p:
            words = p.split()
            kinds = [_kind(w) for w in words]
            if all(w.lower() in JOINING or k in "ncvb" for w, k in zip(words, kinds)) and any(k in "nc" for k in kinds):
                out += [w for w in words if w.lower() not in JOINING]
                continue
        out.append(p)
    return out


def _values(body: str, held: list[str], seps: str) -> list[str]:
    """The values of a text in order of writing, as they are written, without enclosing quotes and blanks."""
    got = _pieces(body, seps)
    if held:
        each = iter(held)
        got = [_SHIELDED.sub(lambda _: next(each), p).strip() for p in got]
    return got


def _family(present: str) -> list[str]:
    """Candidate delimiter sets of a text that holds the separators present."""
    full = ["", present, present.replace(",", ""), *present]
    return list(dict.fromkeys([*full, *("".join(two) for two in itertools.combinations(present, 2))]))


class Judge:
    """Judgements of signatures, each worked out once while it is remembered."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[str, list[tuple[str, bool, int]], frozenset[int], str]] = {}
        lexemes = _Lexemes()
        self.sign = lambda body: _LEXEME.sub(lambda m: lexemes[m[0]], body)

    def read(self, text: str | None) -> tuple | None:
        """(shielded text, shielded values, what its signature was judged), or None where there is no value."""
        if text is None:
            return None
        t = text.strip(" \r\n")
        if len(t) < 5 and t.strip().lower() in MISSING:
            return None
        body, held = _shield(t)
        return body, held, self.of(body)

    def judged(self, text: str | None) -> tuple | None:
        got = self.read(text)
        return got and got[2]

    def of(self, body: str) -> tuple[str, list[tuple[str, bool, int]], frozenset[int], str]:
        """(dialect, (delimiter set, regular, places to compare) of each candidate, places of the regular ones, signature)."""
        sig = self.sign(body)
        got = self.held.get(sig)
        if got is None:
            present = "".join(s for s in SEPARATORS if s in sig)
            rated = []
            for seps in _family(present):
                kinds = [_kind(p) for p in _pieces(sig, seps)]
                k = set(kinds)
                ranged = len(kinds) == 3 and sum(x in "nc" for x in kinds) == 2 and kinds.count("v") == 1
                regular = "x" not in k and not {"n", "c"} <= k and (k <= {"n", "c", "b", "e"} or k <= {"v", "b", "e"} or ranged)
                rated.append((seps, regular, 2 if ranged else len(kinds)))
            got = present, rated, frozenset(n for _, r, n in rated if r), sig
            if len(self.held) > MOST_HELD:
                self.held.clear()
            self.held[sig] = got
        return got


_FIELDS = ("raw_salt", "raw_composition")
_SCORES = "source string, field string, dialect string, seps string, n long, regular long, compared long, agrees long"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the judgements of every source, field, dialect and delimiter set."""
    judge, seen = Judge(), {}

    def flush() -> pa.RecordBatch:
        total: dict[tuple[str, str, str, str], list[int]] = {}
        for (source, *_), (k, left, right) in seen.items():
            for field, own, other in ((_FIELDS[0], left, right), (_FIELDS[1], right, left)):
                if own is None or not own[0]:
                    continue
                counts = other[2] if other else ()
                for seps, regular, n in own[1]:
                    row = total.setdefault((source, field, own[0], seps), [0, 0, 0, 0])
                    row[0] += k
                    row[1] += k * regular
                    row[2] += k * bool(counts)
                    row[3] += k * (n in counts)
        keys, values = list(zip(*total)) or [()] * 4, list(zip(*total.values())) or [()] * 4
        names = ["source", "field", "dialect", "seps", "n", "regular", "compared", "agrees"]
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string()) for k in keys] + [pa.array(v, pa.int64()) for v in values], names)

    for b in batches:
        for source, salt, composition in zip(*(b.column(c).to_pylist() for c in ("source", *_FIELDS))):
            left, right = judge.judged(salt), judge.judged(composition)
            row = seen.get(key := (source, left and left[3], right and right[3]))
            if row is None:
                seen[key] = [1, left, right]
            else:
                row[0] += 1
        if len(seen) > MOST_HELD:
            yield flush()
            seen.clear()
    if seen:
        yield flush()


def delimiter_scores(cases: DataFrame) -> DataFrame:
    """source, field, dialect, seps, score: how regular and count-consistent a delimiter set is over all records of a source."""
    c = cases.select(F.coalesce("source", F.lit("")).alias("source"), *_FIELDS).mapInArrow(_judged, _SCORES)
    c = c.groupBy("source", "field", "dialect", "seps").agg(*(F.sum(x).alias(x) for x in ("n", "regular", "compared", "agrees")))
    score = (F.col("regular") + 0.5) / (F.col("n") + 1) * ((F.col("agrees") + 0.5) / (F.col("compared") + 1))
    return c.select("source", "field", "dialect", "seps", score.alias("score"))


def _splitter(scores: dict[tuple[str, str, str], float] | None):
    """A function over Arrow batches; scores by (source + field, dialect, delimiter set), or None where each row brings its source's own."""

    def choose(own, other, prior) -> str:
        dialect, rated, *_ = own
        counts = other[2] if other else ()
        best, top = "", -1.0
        for seps, regular, n in rated:
            s = (DEPARTS + (1 - DEPARTS) * prior(dialect, seps)) * (1.0 if regular else IRREGULAR) * (1.0 if not counts or n in counts else DISAGREES)
            if s > top or s == top and len(seps) < len(best):
                best, top = seps, s
        return best

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, chosen = Judge(), {}
        for b in batches:
            ids, fields, places, values = [], [], [], []
            own_scores = b.column("scores").to_pylist() if scores is None else itertools.repeat(None)

            def put(case, field, got):
                n = len(got)
                at = range(1, n + 1)
                if "" in got:
                    at = [k for k in at if got[k - 1] != ""]
                    got, n = [v for v in got if v != ""], len(at)
                if n > 1:
                    ids.extend([case] * n)
                    fields.extend([field] * n)
                    places.extend(at)
                    values.extend(got)

            for case, source, salt, composition, canonical, mine in zip(*(b.column(c).to_pylist() for c in ("case_id", "source", *_FIELDS, "canonical")), own_scores):
                left, right = judge.read(salt), judge.read(composition)
                for field, own, other in ((_FIELDS[0], left, right), (_FIELDS[1], right, left)):
                    if own is None or not own[2][0] and " " not in own[0]:
                        continue
                    key = source, field, own[2][3], other and other[2][3]
                    seps = chosen.get(key)
                    if seps is None:
                        held = dict(mine) if mine else {}
                        prior = (lambda d, s, f=field: scores.get((source + f, d, s), 0.0)) if scores is not None else (lambda d, s, f=field: held.get(f"{f} {d} {s}", 0.0))
                        if len(chosen) > MOST_HELD:
                            chosen.clear()
                        seps = chosen[key] = choose(own[2], other and other[2], prior)
                    put(case, field, _values(own[0], own[1], seps))
                if canonical is not None and canonical.strip():
                    put(case, "canonical", _values(*_shield(canonical.strip()), "-–|"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(places, pa.int32()), pa.array(values, pa.string())], ["case_id", "field", "pos", "val"])

    return split


def split_packed(cases: DataFrame, most_scores: int = MOST_SCORES) -> DataFrame:
    """case_id, field, pos, val of every value of a field that holds more than one.

    Partial sums of the judgements are the only thing that is aggregated; records choose and split where they lie.
    """
    # distinct records first: an exact double is one record, and a hot source is spread by its records
    cases = cases.select("case_id", F.coalesce("source", F.lit("")).alias("source"), *_FIELDS, "canonical").distinct()
    scores = delimiter_scores(cases).persist()
    shape = "case_id long, field string, pos int, val string"
    if scores.count() <= most_scores:
        held = {(r[0] + r[1], r[2], r[3]): r[4] for r in scores.collect()}  # at most most_scores rows
        out = cases.mapInArrow(_splitter(held), shape)
    else:
        key = F.concat_ws(" ", "field", "dialect", "seps")
        own = scores.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(key, "score"))).alias("scores"))  # delimiter sets of one source
        out = cases.join(own, "source", "left").mapInArrow(_splitter(None), shape)
    scores.unpersist()
    return out.distinct()
