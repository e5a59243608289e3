"""Problem 5: text of scanned pages repaired into continuous text.

A noisy channel: what was printed went through a reader that confuses characters, tears words and breaks them at line
ends. The language model (words and pairs of neighbours) is counted over all running text of the corpus, the
probabilities of the confusions over all scanned pages, from words that become known by undoing one confusion. A doubtful
word is decoded character by character along the prefixes of the vocabulary, with any number of confusions undone; for
each line, the candidates of its tokens (as read, decoded, joined with the next token) form a lattice that Viterbi
decodes.

Running headers, footers and page numbers are taken off first, so a word broken at the end of a page finds its rest on
the next. They are found by repetition: a line at a page's edge is page matter if, figures aside, it stands in the
same place on several pages of its report, or if lines of its shape (kinds of words, figures, the report's own number) stand at the
edges of the pages of the corpus far more often than inside them. A line of figures only, or with a figure set apart by
a gap, and a line that begins or ends with the report's number need no repetition.

Defined results: null, empty and blank texts give no row; a text of one line has no broken words; equal rows count
once; an unknown word without a known likeness stays as it is; empty tables give an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.session import written

#: Pairs (printed, read) that look alike (fixed values); their probabilities are counted.
ALIKE = (
    ("e", "c"), ("c", "e"), ("t", "†"), ("a", "á"), ("i", "!"), ("l", "!"), ("n", "ri"), ("ri", "n"), ("d", "cl"), ("cl", "d"), ("o", "0"), ("O", "0"), ("l", "1"), ("I", "1"), ("i", "1"),
    ("u", "ii"), ("h", "li"), ("li", "h"), ("b", "h"), ("h", "b"), ("m", "rn"), ("rn", "m"), ("m", "nn"), ("w", "vv"), ("vv", "w"), ("é", "ê"), ("è", "ê"), ("i", "l"), ("l", "i"), ("l", "I"), ("I", "l"), ("i", "í"),
    ("o", "ó"), ("u", "ú"), ("e", "é"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("S", "5"), ("s", "5"), ("B", "8"), ("Z", "2"), ("g", "9"), ("g", "q"), ("q", "g"), ("G", "6"), ("b", "6"), ("ö", "6"), ("ó", "6"),
    ("E", "F"), ("F", "E"), ("F", "P"), ("3", "8"), ("8", "3"), ("3", "s"), ("2", ","), ("2", "z"), ("2", "Z"), ("4", "q"), ("4", "a"), ("4", "A"), ("4", "h"), ("t", "f"), ("f", "t"), ("s", "8"), ("y", "v"), ("v", "y"), ("r", "n"), ("n", "r"), ("u", "n"), ("n", "u"),
    ("o", "c"), ("c", "o"), ("ä", "a"), ("ü", "u"), ("ö", "o"), ("ß", "B"), ("ß", "b"), ("ç", "c"), ("ã", "a"), ("ñ", "n"), ("D", "O"), ("O", "D"), ("Q", "O"), ("O", "Q"),
)
#: Letters that are read for figures (fixed values).
FIGURES = {"l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "O": "0", "o": "0", "D": "0", "Q": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "q": "9", "g": "9", "b": "6", "G": "6", "A": "4"}
#: An entry of the model makes up at least this share of all words or pairs, so at most 1 / LEAST entries each are sent out.
LEAST = 2e-6
#: Weight of words seen on scanned pages only, against those of clean text.
PAGES = 0.02
#: A word of clean text is known if its share there is at least this part of its share on scanned pages: a misreading is far more frequent on them, whatever the size of the input.
KNOWN = 0.02
#: Letters from which on every further one makes an unknown word less likely, by as much as each of those.
LETTERS = 9
#: Share of words that are torn by a blank, and the least probability of a confusion.
TORN, FLOOR = 2e-3, 1e-6
UNKNOWN = 1e-13

_EDGE = ".,;:()[]{}\"'’‘«»“”„?!…—–¿¡*"
_HYPHENS = "-‐‑¬\xad"
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:]\d+)*(?:[eE]-?\d+)?%?(?:[-–/]\d+(?:[.,]\d+)*)?\Z")
_COMPOUND = re.compile(r"(?:[A-Z][a-z]?F\d?)(?:[-/][A-Z][a-z]?F\d?)*\Z")
_SEPARATOR = re.compile(r"[-/'’]")
_SEPARATED = re.compile(r"[^-/'’]+[-/'’]")
_ROMAN = re.compile(r"(?:[ivxlc]+|[IVXLC]{2,})\Z")
_MARKS = ".,;:!?()[]{}<>\"'«»“”„-–—/"
_FIGURE_LIKE = re.compile(r"[\dlIOSB|]*\d[\dlIOSB|]*\Z")
_NUMBER_LINE = re.compile(r"[\[\](){}<>|/\s–—-]*(?:[#r]|R#?)(?:[\[\](){}<>|/\s–—-]+(?:[#r]|R#?))*[\[\](){}<>|/\s–—-]*\Z")
_NUMBER_TOKEN = re.compile(r"[\[\](){}<>|/–—-]*(?:[#r]|R#?)?[\[\](){}<>|/–—-]*\Z")
_GAP = re.compile(r"(?P<left>\S.*?)\s{2,}(?P<right>\S.*)\Z")
#: A shape is page matter from so many edges on, if its share of all edges is so many times (in nats) that of all inner lines.
EDGES, ODDS = 6, 3.0
#: A line is repeated from two pages on, and on this share of its report's pages.
REPEATED = 0.1


def _like(a: str, b: str, most: int) -> bool:
    """Whether two texts of equal length differ in at most `most` places."""
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= most


def line_key(line: str, depth: int) -> int:
    """What repeated lines have in common: the hash of their text without its figures and of their place, counted from the top or, below 0, from the bottom."""
    return xxhash.xxh64_intdigest(f"{depth} " + re.sub(r"\d+", "#", " ".join(line.split()).lower())) - 2**63


def _is_report(core: str, report: str | None) -> bool:
    return bool(report) and len(core) >= len(report) and (_like(core[:len(report)], report, 2) or _like(core[-len(report):], report, 2))


def word_kind(w: str, report: str | None) -> str:
    """R(eport number), #, r(oman), U(pper), C(apitalised), l(ower) or ? with the punctuation of the word."""
    core = w.strip(_MARKS)
    if not core:
        return w
    if core.isalpha() and core.islower() and not _ROMAN.match(core):
        kind = "l"
    elif _is_report(core, report):
        kind = "R" if len(core) == len(report) else "R#"
    elif _FIGURE_LIKE.match(core):
        kind = "#"
    elif _ROMAN.match(core):
        kind = "r"
    elif core.isupper():
        kind = "U" if len(core) > 1 else "C"
    else:
        kind = "C" if core[0].isupper() or core[0] == "0" else "l" if core[0].isalpha() else "?"
    if len(core) == len(w):
        return kind
    at = w.find(core)
    return w[:at] + kind + w[at + len(core):]


def _shape_tokens(line: str, report: str | None) -> Iterator[str]:
    """word_kind of the words of a line, runs of plain U, C and l as one token."""
    held, run = None, False
    for w in line.split():
        kind = word_kind(w, report)
        if kind == held and kind in "UCl":
            run = True
            continue
        if held is not None:
            yield f"{held}+" if run else held
        held, run = kind, False
    if held is not None:
        yield f"{held}+" if run else held


def line_shape(line: str, report: str | None) -> str:
    """The kinds of the words of a line, with their punctuation."""
    return " ".join(_shape_tokens(line, report))


class Matter:
    """Shapes of lines that are page matter; picklable, of bounded size."""

    def __init__(self, shapes: frozenset[str] = frozenset()) -> None:
        self.shapes = shapes
        self.begun = {" ".join(s.split(" ")[:k]) for s in shapes for k in range(1, s.count(" ") + 2)}

    def holds(self, line: str, report: str | None) -> bool:
        """Whether a line is page matter by its shape, wherever it stands. A line is read only as far as it can still be."""
        s = line.strip()
        if not s:
            return False
        if s[-1] not in ".,;:!?" and report:
            words = s.split()
            first, last = words[0].strip(_MARKS), words[-1].strip(_MARKS)
            if len(words) > 1 and any(len(x) == len(report) and _like(x, report, 2) for x in (first, last)):
                return True
        if s[-1] not in ".!?" and ("  " in s or "\t" in s) and (m := _GAP.match(s)) and (_FIGURE_LIKE.match(m["left"]) or _FIGURE_LIKE.match(m["right"])):
            return True
        shape, known, number = "", True, True
        for token in _shape_tokens(s, report):
            shape = f"{shape} {token}" if shape else token
            known = known and shape in self.begun
            number = number and bool(_NUMBER_TOKEN.match(token))
            if not (known or number):
                return False
        return known and shape in self.shapes or bool(_NUMBER_LINE.match(shape))

    def lines(self, lines: list[str], report: str | None, everywhere: bool, running: frozenset[int] = frozenset()) -> set[int]:
        """Numbers of the lines of page matter: from the edges of a page inwards, or everywhere in a quotation that may run over pages."""
        full = [i for i, x in enumerate(lines) if x.strip()]
        if everywhere:
            return {i for i in full if len(full) > 1 and self.holds(lines[i], report)}
        out: set[int] = set()
        for order, step in ((full, 1), (full[::-1], -1)):
            for k, i in enumerate(order):
                depth = k if step > 0 else -1 - k
                if i in out or not (running and line_key(lines[i], depth) in running or self.holds(lines[i], report)):
                    break
                out.add(i)
        return out


def _lines_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the shapes of lines at and inside the edges of pages, and the lines of each page."""
    names = ["report", "line", "page", "shape", "edge", "inside"]
    for b in batches:
        shapes: dict[str, list[int]] = {}
        rows = []
        for report, text in zip(b.column("report").to_pylist(), b.column("text").to_pylist()):
            full = [x for x in (text or "").split("\n") if x.strip()]
            if not full:
                continue
            page = xxhash.xxh64_intdigest(text) - 2**63
            rows += [(report, key, page, None, 0, 0) for key in {line_key(x, k if 2 * k < len(full) else k - len(full)) for k, x in enumerate(full)}]
            rows.append((report, None, page, None, 0, 0))
            for k, x in enumerate(full):
                if k in (0, len(full) - 1) or 1 < k < len(full) - 2:  # the second lines may be either
                    shapes.setdefault(line_shape(x, report), [0, 0])[0 < k < len(full) - 1] += 1
        rows += [(None, None, None, k, *v) for k, v in shapes.items()]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names)


def learn_matter(pages: DataFrame, keys: bool = True) -> tuple[Matter, DataFrame | None]:
    """The shapes of page matter over all pages (report, text), and with keys the lines repeated in their place on the pages of each report (report, running).

    A kept shape makes up at least EDGES edges and a share of 1e-5 of them, so at most 1e5 shapes are sent out.
    """
    seen = written(pages.select("report", "text").where("text is not null").mapInArrow(_lines_seen, "report string, line long, page long, shape string, edge long, inside long"), "lines")
    shapes = seen.where("page is null").groupBy("shape").agg(F.sum("edge").alias("edge"), F.sum("inside").alias("inside"))
    total = shapes.agg(F.sum("edge"), F.sum("inside")).first()
    edges, inside = (total[0] or 0) + 1, (total[1] or 0) + 1
    odds = F.log((F.col("edge") + 0.5) / edges) - F.log((F.col("inside") + 0.5) / inside)
    kept = shapes.where((F.col("edge") >= EDGES) & (F.col("edge") >= edges * 1e-5) & (odds > ODDS)).select("shape").collect()
    matter = Matter(frozenset(r[0] for r in kept))
    if not keys:
        return matter, None
    # copies of a page count once
    each = seen.where("page is not null and report is not null").select("report", "line", "page").distinct().groupBy("report", "line").agg(F.count("*").alias("n"))
    whole = each.where("line is null").select("report", F.col("n").alias("pages"))
    often = each.where("line is not null").join(whole, "report").where((F.col("n") >= 2) & (F.col("n") >= F.col("pages") * REPEATED))
    return matter, often.groupBy("report").agg(F.collect_list("line").alias("running"))  # lines that many of its pages share


def strip(token: str) -> str:
    return token.strip(_EDGE)


def _class(word: str) -> str:
    """What stands for a word in the model: figures and formulas are classes."""
    if _NUMBER.match(word):
        return "0"
    if _COMPOUND.match(word) and ("-" in word or "/" in word):
        return "F-F"
    return word


class Model:
    """Words, pairs and confusions; picklable, of bounded size."""

    def __init__(self, words: dict[str, float], pairs: dict[tuple[str, str], int], confusions: dict[tuple[str, str], float] | None = None, known: frozenset[str] | None = None, matter: Matter | None = None) -> None:
        self.words, self.pairs, self.matter = words, pairs, matter or Matter()
        self.known = frozenset(w for w, n in words.items() if n >= 1) if known is None else known
        self.total = sum(words.values()) or 1.0
        self.confusions = confusions or {r: 1e-4 for r in ALIKE}
        self.undo: dict[str, list[tuple[str, float]]] = {}
        for (x, y), p in self.confusions.items():
            self.undo.setdefault(y, []).append((x, math.log(max(p, FLOOR))))
        # a confusion may be read from a confusion: ü for u, u for ii
        self.rules: dict[str, list[tuple[str, list[tuple[str, float]]]]] = {}
        for y, xs in self.undo.items():
            every = dict(xs)
            for x, p in xs:
                for x2, p2 in self.undo.get(x, ()):
                    if x2 != y and p + p2 > every.get(x2, -math.inf):
                        every[x2] = p + p2
            self.rules.setdefault(y[0], []).append((y, list(every.items())))
        self.sorted: list[str] = []
        self.begun: dict[str, bool] = {}
        self.held: dict[str, list[tuple[str, float]]] = {}

    def knows(self, word: str) -> bool:
        """Whether a word is a word of the corpus, a number, or made of known parts."""
        if not word or word in self.known:
            return True
        if _NUMBER.match(word):
            return True
        for sep in ("-", "/"):
            if sep in word.strip(sep):
                return all(p in self.known or _NUMBER.match(p) for p in word.split(sep))
        return False

    def log(self, word: str, before: str | None) -> float:
        """log P(word | word before), interpolated with the word alone."""
        w = _class(word)
        one = self.words.get(w, 0.0) / self.total
        if not one and self.knows(word):
            one = 1 / self.total
        if before is not None and one:
            two = self.pairs.get((before, w), 0)
            if two:
                return math.log(0.7 * two / max(self.words.get(before, two), two) + 0.3 * one)
        if not one:
            return math.log(UNKNOWN) * max(1.0, len(w) / LETTERS)
        return math.log(0.3 * one + UNKNOWN)

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """Known words that may have been read as word, with the log probability of the confusions."""
        got = self.held.get(word)
        if got is None:
            got = self.held[word] = self._candidates(word)
            if len(self.held) > 200_000:
                self.held.clear()
        return got

    def begins(self, prefix: str) -> bool:
        """Whether a known word, or one of known parts, begins with prefix."""
        got = self.begun.get(prefix)
        if got is None:
            if not self.sorted:
                self.sorted = sorted(self.known)
            got = self._prefix(prefix)
            if not got and (m := _SEPARATED.match(prefix)):
                *parts, last = _SEPARATOR.split(prefix)
                got = all(p in self.known or p.isdigit() for p in parts) and (not last or last.isdigit() or self._prefix(last))
            if len(self.begun) > 500_000:
                self.begun.clear()
            self.begun[prefix] = got
        return got

    def _prefix(self, prefix: str) -> bool:
        i = bisect.bisect_left(self.sorted, prefix)
        return i < len(self.sorted) and self.sorted[i].startswith(prefix)

    def _candidates(self, word: str) -> list[tuple[str, float]]:
        """The words are decoded along the prefixes of the vocabulary, so only what can become a word is followed."""
        out: dict[str, float] = {}
        states: list[dict[str, float]] = [{} for _ in range(len(word) + 1)]
        states[0][""] = 0.0
        for at, c in enumerate(word):
            here, states[at] = states[at], {}
            if not here:
                continue
            moves = [(1, c, 0.0)] + [(len(y), x, p) for y, xs in self.rules.get(c, ()) if word.startswith(y, at) for x, p in xs]
            for v, lp in here.items():
                for k, x, p in moves:
                    u, nxt = v + x, states[at + k]
                    old = nxt.get(u)
                    if old is None and self.begins(u) or old is not None and old < lp + p:
                        nxt[u] = lp + p
        for v, p in states[-1].items():
            if v != word and (v in self.known or not _NUMBER.match(v) and _SEPARATOR.search(v) and self._parts(v)):
                out[v] = p
        figures = "".join(FIGURES.get(c, c) for c in word)
        if figures != word and re.search(r"\d", word):
            figures = re.sub(r"(?<=\d)c(?=-\d)", "e", "".join(c if c == "e" else FIGURES.get(c, c) for c in word))
            if _NUMBER.match(figures):
                out[figures] = -7.0
        elif re.search(r"\dc-\d", word) and _NUMBER.match(v := word.replace("c-", "e-")):
            out[v] = -7.0
        elif figures != word and figures.isdigit() and word not in self.known:
            out[figures] = -9.0 * len(word)
        return list(out.items())

    def _parts(self, word: str) -> bool:
        parts = _SEPARATOR.split(word)
        return all(parts) and all(p in self.known or p.isdigit() for p in parts)


def _cores(token: str, model: Model) -> list[str]:
    """The word in a token, without punctuation around it; marks that may be misread letters are tried as part of it."""
    core = strip(token)
    out = [core]
    if core and not model.knows(core):
        at = token.find(core)
        if token[at + len(core):at + len(core) + 1] in "!," and at + len(core) < len(token):
            out.append(core + token[at + len(core)])
        if at and token[at - 1] == "!":
            out.append("!" + core)
    return out


def decode(tokens: list[str], model: Model) -> list[tuple[int, int, str]]:
    """Viterbi over the candidate words of a line: (first token, tokens, right form) of every token that changes."""
    cores = [_cores(t, model) for t in tokens]
    doubt = [bool(c[0]) and not model.knows(c[0]) for c in cores]
    if not any(doubt):
        return []
    n = len(tokens)
    lattice: list[list[tuple[int, str, float, bool]]] = []  # (tokens, word, channel, changed)
    for i in range(n):
        here = [(1, cores[i][0], 0.0, False)]
        if doubt[i]:
            for c in cores[i]:
                here += [(1, w, p, True) for w, p in model.candidates(c)]
        if i + 1 < n and cores[i][0] and cores[i + 1][0] and (doubt[i] or doubt[i + 1]) and tokens[i][-1:] == cores[i][0][-1:] and tokens[i + 1][:1] == cores[i + 1][0][:1]:
            whole = cores[i][0] + cores[i + 1][0]
            if whole[-1].isalnum() and not _NUMBER.match(whole):
                if whole in model.known or ("-" in whole and model.knows(whole)):
                    here.append((2, whole, math.log(TORN), True))
                elif doubt[i] and doubt[i + 1]:
                    here += [(2, w, math.log(TORN) + p, True) for w, p in model.candidates(whole)]
        lattice.append(here)
    best: list[dict[str, tuple[float, tuple | None, tuple]]] = [{} for _ in range(n + 1)]
    best[0] = {"": (0.0, None, ())}
    for i in range(n):
        for before, (score, _, _) in best[i].items():
            for k, w, p, changed in lattice[i]:
                c = _class(w) if w else before
                s = score + p + (model.log(w, before or None) if w else 0.0)
                old = best[i + k].get(c)
                if old is None or s > old[0]:
                    best[i + k][c] = (s, (i, before), (k, w, changed))
    end = max(best[n], key=lambda c: best[n][c][0])
    out, at, key = [], n, end
    while at:
        _, (i, before), (k, w, changed) = best[at][key]
        if changed:
            out.append((i, k, w))
        at, key = i, before
    return out[::-1]


def _joined(a: str, b: str, model: Model) -> str | None:
    """The whole word of which a ends a line and b begins the next, or None."""
    b = strip(b)
    hyphen = a[-1:] in _HYPHENS and a[-1:] != ""
    a = a.rstrip(_HYPHENS).lstrip(_EDGE) if hyphen else a.lstrip(_EDGE)
    if not a or not b or not (a[-1].isalnum() or a[-1] in "†!ﬁﬂﬀ'’") or not b[0].isalnum() and b[0] not in "†!ﬁﬂﬀ":
        return None
    if hyphen:
        if _NUMBER.match(a) and _NUMBER.match(b):
            return None
        plain, kept = a + b, f"{a}-{b}"
        p, k = (model.words.get(w, 1.0) if w in model.known else 0.0 for w in (plain, kept))
        if p or k:
            return plain if p >= k else kept
        if _COMPOUND.match(a.split("-")[-1]) or _COMPOUND.match(b):
            return kept
        got = [(lp + model.log(w, None), w) for c in (plain, kept) for w, lp in model.candidates(c)]
        if got:
            return max(got)[1]
        if model.knows(kept):
            return kept
        return kept if b[0].isupper() or b[0].isdigit() or a[-1].isdigit() else plain
    whole = a + b
    if not a[-1].isalpha() or not b[0].islower():
        return None
    if whole in model.known and not (model.knows(a) and model.knows(b)):
        return whole
    if whole in model.known and not model.pairs.get((a, b)) and model.words[whole] > 10 * min(model.words.get(a, 0), model.words.get(b, 0)):
        return whole
    if not model.knows(a) and not model.knows(b):
        got = [(lp + model.log(w, None), w) for w, lp in model.candidates(whole)]
        ab = [w for c in (a, b) for w, _ in model.candidates(c)]
        if got and not ab:
            return max(got)[1]
    return None


def repair(text: str | None, following: str | None, report: str | None, everywhere: bool, model: Model, running: frozenset[int] = frozenset()) -> list[tuple[int, str, str]]:
    """(line number, kind, word) of everything found in a page or quotation; following: the page after it."""
    if not text or not text.strip():
        return []
    lines = text.split("\n")
    matter = model.matter.lines(lines, report, everywhere, running)
    out = [(i + 1, "furniture", "") for i in sorted(matter)]
    body = [(i, x.split()) for i, x in enumerate(lines) if i not in matter and x.strip()]
    rest = None
    if following and following.strip():
        more = following.split("\n")
        off = model.matter.lines(more, report, False, running)
        rest = next((x.split() for i, x in enumerate(more) if i not in off and x.strip()), None)
    carried = False  # whether the first token of the line belongs to the line before
    for k, (i, tokens) in enumerate(body):
        nxt = body[k + 1][1] if k + 1 < len(body) else rest
        apart = k + 1 < len(body) and any(not lines[j].strip() for j in range(i + 1, body[k + 1][0])) and not everywhere and not any(j in matter for j in range(i, body[k + 1][0]))
        word = None
        if nxt and not apart:
            last = tokens[-1]
            word = _joined(last, nxt[0], model) if len(tokens) > carried else None
        own = tokens[carried:len(tokens) - (word is not None)]
        for _, _, w in decode(own, model):
            out.append((i + 1, "char", w))
        if word is not None:
            out.append((i + 1, "joined", word))
        carried = word is not None
    return out


def _first_line(text: str | None, report: str | None, model: Model, running: frozenset[int]) -> list[str] | None:
    """Tokens of the first line of a page that isn't page matter."""
    lines = (text or "").split("\n")
    off = model.matter.lines(lines, report, False, running)
    return next((x.split() for i, x in enumerate(lines) if i not in off and x.strip()), None)


def _over_page(text: str | None, following: str | None, report: str | None, model: Model, running: frozenset[int]) -> str | None:
    """The word that a page's last token and the first one of the page after it make, or None."""
    rest = _first_line(following, report, model, running)
    if not rest or not text:
        return None
    lines = text.split("\n")
    matter = model.matter.lines(lines, report, False, running)
    body = [(i, x.split()) for i, x in enumerate(lines) if i not in matter and x.strip()]
    if not body:
        return None
    # lines of one token may belong to the line before, so the last line with more is where to start
    at = next((k for k in range(len(body) - 1, -1, -1) if len(body[k][1]) > 1), 0)
    word = None
    for k in range(at, len(body)):
        i, tokens = body[k]
        carried = word is not None
        nxt = body[k + 1][1] if k + 1 < len(body) else rest
        apart = k + 1 < len(body) and any(not lines[j].strip() for j in range(i + 1, body[k + 1][0]))
        word = _joined(tokens[-1], nxt[0], model) if len(tokens) > carried and not apart else None
    return word


def repaired_text(text: str | None, report: str | None, model: Model, following: str | None = None, before: str | None = None, everywhere: bool = False, running: frozenset[int] = frozenset()) -> str:
    """The text of a page or quotation as paragraphs of continuous text, without page matter, with right words.

    following, before: the pages after and before it. A word broken at the end of a page is whole on that page, and its
    rest is left out on the next one.
    """
    if not text:
        return ""
    lines = text.split("\n")
    matter = model.matter.lines(lines, report, everywhere, running)
    out: list[list[str]] = [[]]
    carried = _over_page(before, text, report, model, running)
    rest = _first_line(following, report, model, running)
    body = [(i, x) for i, x in enumerate(lines) if i not in matter and x.strip()]
    for k, (i, x) in enumerate(body):
        tokens = x.split()
        if k and out[-1] and carried is None:
            between = range(body[k - 1][0] + 1, i)
            if x.startswith("   ") or any(not lines[j].strip() for j in between) and not any(j in matter for j in between):
                out.append([])
        skip = carried is not None
        carried = None
        nxt = body[k + 1][1].split() if k + 1 < len(body) else rest
        apart = k + 1 < len(body) and not everywhere and any(not lines[j].strip() for j in range(i + 1, body[k + 1][0]))
        word = _joined(tokens[-1], nxt[0], model) if nxt and not apart and len(tokens) > skip else None
        own = tokens[skip:len(tokens) - (word is not None)]
        at = 0
        for j, n, w in decode(own, model):
            out[-1] += own[at:j]
            joined = "".join(own[j:j + n])
            lead, tail = joined[:len(joined) - len(joined.lstrip(_EDGE))], joined[len(joined.rstrip(_EDGE)):]
            out[-1].append(lead.replace("!", "") + w + (tail if not w.endswith("2") else tail[1:] if tail[:1] == "," else tail))
            at = j + n
        out[-1] += own[at:]
        if word is not None:
            tail = nxt[0][len(nxt[0].rstrip(_EDGE)):]
            out[-1].append(word + tail)
            carried = word
    return "\n\n".join(" ".join(p) for p in out if p)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and pairs. Tokens are counted as they are written; their forms in the model are worked out once for each."""
    words, pairs, read = Counter(), Counter(), Counter()
    forms: dict[str, str] = {}

    def form(token: str) -> str:
        got = forms.get(token)
        if got is None:
            got = forms[token] = _class(strip(token))
        return got

    def flush() -> pa.RecordBatch:
        total: dict[tuple[str, str], list[int]] = {}
        for which, counter in enumerate((words, read)):
            for t, n in counter.items():
                w = strip(t)
                keys = [(form(t), "")] if w else []
                if not which and ("-" in w or "/" in w or "'" in w):
                    keys += [(p, "") for p in re.split(r"[-/']", w) if p and not p.isdigit()]
                for k in keys:
                    total.setdefault(k, [0, 0])[which] += n
        for (a, b), n in pairs.items():
            if (x := form(a)) and (y := form(b)):
                total.setdefault((x, y), [0, 0])[0] += n
        for c in (words, pairs, read, forms):
            c.clear()
        keys, values = list(total), list(total.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())],
            ["word", "next", "clean", "read"],
        )

    for b in batches:
        for layout, text in zip(b.column("layout").to_pylist(), b.column("text").to_pylist()):
            if not text:
                continue
            tokens = text.split()
            if layout == "page":
                read.update(tokens)
            else:
                words.update(tokens)
                pairs.update(zip(tokens, tokens[1:]))
        if len(pairs) + len(words) + len(read) > 400_000:
            yield flush()
    if words or read:
        yield flush()


def language_model(segments: DataFrame) -> Model:
    """Words and pairs of all segments; entries below the share LEAST are too rare to decide anything and aren't sent out."""
    c = segments.select("layout", "text").where("text is not null").mapInArrow(_count, "word string, next string, clean long, read long")
    c = written(c.groupBy("word", "next").agg(F.sum("clean").alias("clean"), F.sum("read").alias("read")), "model")
    singles = c.where("next = ''")
    totals = c.groupBy((F.col("next") == "").alias("single")).agg(F.sum("clean"), F.sum("read")).collect()  # two rows
    clean_total, read_total = (sum(r[i] or 0 for r in totals if r[0]) for i in (1, 2))
    words_total = clean_total + read_total
    pairs_total = sum(r[1] or 0 for r in totals if not r[0])
    clean = singles.where((F.col("clean") >= 2) & (F.col("clean") >= words_total * LEAST) | (F.col("read") >= 3) & (F.col("read") >= words_total * LEAST))
    kept = clean.select("word", "clean", "read").collect()  # at most 1 / LEAST rows
    words = {r[0]: r[1] + PAGES * r[2] for r in kept}
    known = frozenset(r[0] for r in kept if r[1] >= 2 and r[1] * read_total >= KNOWN * r[2] * clean_total)
    pairs = {(r[0], r[1]): r[2] for r in c.where("next <> ''").where((F.col("clean") >= 2) & (F.col("clean") >= pairs_total * LEAST)).select("word", "next", "clean").collect()}  # at most 1 / LEAST rows
    return Model(words, pairs, known=known)


def confusion_model(spark: SparkSession, pages: DataFrame, model: Model) -> Model:
    """The model with confusion probabilities counted over all pages."""
    sent = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        rules, chars = Counter(), Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                for token in (text or "").split():
                    w = strip(token)
                    if not w:
                        continue
                    if m.knows(w):
                        chars.update(w)
                        continue
                    hits = {}
                    for y, xs in m.undo.items():
                        at = w.find(y)
                        while at >= 0:
                            for x, _ in xs:
                                v = w[:at] + x + w[at + len(y):]
                                if v in m.known:
                                    hits[v] = (x, y)
                            at = w.find(y, at + 1)
                    if len(hits) == 1:
                        rules.update(hits.values())
        keys = [*rules, *((c, "") for c in chars)]
        values = [*rules.values(), *chars.values()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(values, pa.int64())], ["x", "y", "n"])

    got = pages.select("text").mapInArrow(count, "x string, y string, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    chars, rules = {}, {}
    for x, y, n in got.collect():  # one row a confusion or character
        (rules if y else chars)[(x, y) if y else x] = n
    base = sum(chars.values()) or 1
    return Model(model.words, model.pairs, {(x, y): (rules.get((x, y), 0) + 0.01) / (min((chars.get(c, 0) for c in x), default=0) + base * 1e-3) for x, y in ALIKE}, model.known, model.matter)


def trained(segments: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the lines repeated on the pages of each report."""
    pages = segments.where("layout = 'page'")
    model = language_model(segments)
    if "report" in segments.columns:
        model.matter, running = learn_matter(pages)
    else:
        running = None
    return confusion_model(segments.sparkSession, pages, model), running


def repair_scans(segments: DataFrame, evidence: DataFrame) -> DataFrame:
    """src, rec_id, line_no, kind, word of everything that a scan's page or quotation needs repaired."""
    spark = segments.sparkSession
    model, running = trained(segments)
    sent = spark.sparkContext.broadcast(model)
    pages = segments.where("layout = 'page'").select("segment_id", "doc_id", "seg_index", "report", "text").distinct()
    # the page after each page by its place, so a document of very many pages is spread over all tasks
    after = pages.select("doc_id", (F.col("seg_index") - 1).alias("seg_index"), F.col("text").alias("following"))
    a = pages.join(after, ["doc_id", "seg_index"], "left").select(F.lit("segments").alias("src"), F.col("segment_id").alias("rec_id"), "report", "text", "following")
    b = evidence.select(F.lit("evidence").alias("src"), F.col("evidence_id").alias("rec_id"), "report", F.col("sentence_text").alias("text"), F.lit(None).cast("string").alias("following")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows = []
            for src, rec, report, text, nxt, often in zip(*(batch.column(c).to_pylist() for c in ("src", "rec_id", "report", "text", "following", "running"))):
                rows += [(src, rec, *x) for x in dict.fromkeys(repair(text, nxt, report, src == "evidence", m, frozenset(often or ())))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                ["src", "rec_id", "line_no", "kind", "word"],
            )

    return a.unionByName(b).join(running, "report", "left").mapInArrow(run, "src string, rec_id long, line_no int, kind string, word string").distinct()


def repaired_pages(segments: DataFrame, evidence: DataFrame) -> DataFrame:
    """src, rec_id, text of every scanned page and quotation as continuous paragraphs."""
    model, running = trained(segments)
    sent = segments.sparkSession.sparkContext.broadcast(model)
    pages = segments.where("layout = 'page'").select("segment_id", "doc_id", "seg_index", "report", "text").distinct()
    after = pages.select("doc_id", (F.col("seg_index") - 1).alias("seg_index"), F.col("text").alias("following"))
    before = pages.select("doc_id", (F.col("seg_index") + 1).alias("seg_index"), F.col("text").alias("before"))
    a = pages.join(after, ["doc_id", "seg_index"], "left").join(before, ["doc_id", "seg_index"], "left").select(F.lit("segments").alias("src"), F.col("segment_id").alias("rec_id"), "report", "text", "following", "before")
    none = F.lit(None).cast("string")
    b = evidence.select(F.lit("evidence").alias("src"), F.col("evidence_id").alias("rec_id"), "report", F.col("sentence_text").alias("text"), none.alias("following"), none.alias("before")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for x in batches:
            src, rec, report, text, following, prior, often = (x.column(c).to_pylist() for c in ("src", "rec_id", "report", "text", "following", "before", "running"))
            fixed = [repaired_text(t, r, m, nxt, prev, s == "evidence", frozenset(o or ())) for s, r, t, nxt, prev, o in zip(src, report, text, following, prior, often)]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(rec, pa.int64()), pa.array(fixed, pa.string())], ["src", "rec_id", "text"])

    return a.unionByName(b).join(running, "report", "left").mapInArrow(run, "src string, rec_id long, text string")
