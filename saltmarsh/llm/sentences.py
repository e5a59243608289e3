"""Problem 2: sentences of running text in many languages and scripts, with their offsets in the document.

Document-centred disambiguation of full stops. One pass over a document collects its unambiguous places: words in lower
case, capitalised words inside sentences (names), words with a full stop before a lower-case word, figure or comma (they
don't end there), and before a word that the document also writes in lower case (they do). What the document says of a
word decides: whether its full stop is an abbreviation's, and whether a capitalised word opens a sentence or is a name.
Only where the document says nothing, or both, the same counts over the corpus are asked. Scripts with terminators of
their own follow those; Thai sentences part at blanks between Thai letters. Quotations and brackets are kept whole.

Defined results: null, empty and blank texts give no row; an empty line ends a sentence; a line that is a heading is
one unit; an unclosed quotation or bracket is an ordinary character; texts are read whole; repeated rows give one set
of sentences; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry of the corpus statistics makes up at least this share of its kind, so at most 1 / LEAST entries a kind are sent out.
LEAST = 1e-5
#: Share of a word's occurrences that open sentences: from here it is an opener, from the lower one it may be.
OPENER, MAYBE = 0.5, 0.03
#: Share of occurrences of a word with full stop that are followed by no opener: from here it is an abbreviation.
ABBREVIATION = 0.25
#: Share of an abbreviation's capitalised successors that are openers: below, it never ends a sentence; from the higher one it mostly does.
ENDS, MOSTLY = 0.1, 0.5
#: Occurrences in the document that the corpus counts for.
PRIOR = 2
#: A document of more characters is indexed in one pass instead of searched for each word.
FEW_CHARACTERS = 50_000
#: A share of successors too small to tell anything.
STRAY = 0.02
#: Occurrences that speak for a word being none of the abbreviations, before any are seen.
FEW = 4

_TERMINATORS = ".!?…。！？．｡‼⁉"
_WIDE = "。！？．｡"
_CLOSERS = "\"'”’»«“」』)）]］〉》"
_PARAGRAPH = re.compile(r"\S(?:.|\n(?![ \t\r\x0b\f]*\n))*", re.DOTALL)
_HEADING = re.compile(r"(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.)[ \t]+(\S[^\n]*)\Z")
_INNER_END = re.compile(r"[^\W\d_A-Z]{3}[.!?…]\s")
_SHUT = re.compile(r"“[^“”]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|\((?:[^()]|\([^()]*\))*\)|（[^（）]*）|\"[^\"]*\"")
_END = re.compile(rf"[{_TERMINATORS}]+")
_TAIL = re.compile(rf"[{re.escape(_CLOSERS)}]*")
_WORD = re.compile(r"[^\W\d_][\w'’\-]*")
_NO_TOKEN = frozenset(" \t\n\r\x0b\x0c\xa0\u2009\u202f\u3000\"“”„«»()（）「」/")
_OPEN = "\"“„«¿¡([（「『‘'"
_THAI = re.compile(r"(?<=[ก-๛])[^\S\n]*\n?[^\S\n]*(?<=\s)(?=[ก-๛])")
_FROM_THAI = re.compile(r"[ก-๛]\s+(?=[^\sก-๛])")
_IS_THAI = re.compile(r"[ก-๛]")
_EAST = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
_LOWER_WORDS = re.compile(r"(?<![\w-])[^\W\d_A-Z]{2,}(?![\w-])")

# unambiguous places
_FIGURE_EAST = re.compile(r"\d[\d.,]*\s?[A-Za-z°%µ/·⁻¹²³-]*\s?[぀-ヿ㐀-鿿ｦ-ﾟก-๛]")
_FIGURE = re.compile(r"\d")
_FIRST = re.compile(r"[(\"“„«¿¡]*([^\W\d_][\w'’\-]*)")
_BEHIND_END = re.compile(r"[!?.]\s+[(\"“„«¿¡]*([^\W\d_][\w'’\-]*)")
_CAPITAL = re.compile(r"[A-ZÀ-ÞЀ-Я][\w'’\-]*")
_STOP = re.compile(r"\.(?:\s+(\S[\w'’\-]*)|(?=[,;:]))")


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of each run of lines between empty lines."""
    at = 0
    for m in re.finditer(r"\n[ \t\r\x0b\f]*\n", text):
        if at < m.start():
            yield at, text[at:m.start()]
        at = m.end()
    if at < len(text):
        yield at, text[at:]


def is_heading(p: str) -> bool:
    """Whether a paragraph is a numbered line in which no sentence ends."""
    m = _HEADING.match(p)
    return bool(m) and not _INNER_END.search(m[1])


def evidence(text: str, out: Counter) -> None:
    """Counts of openers (o, word), words inside sentences (i, word) and successors of full stops (s, word, successor)."""
    seen: list[tuple[str, str, str]] = []
    for _, p in paragraphs(text):
        p = p.strip()
        if not p or is_heading(p):
            continue
        # words in lower case are not counted inside sentences, so only mixed ones such as pH can open one
        if (m := _FIRST.match(p)) and not m[1].islower():
            seen.append(("o", m[1], ""))
        for m in _BEHIND_END.finditer(p):
            at = m.start()
            if not m[1].islower() and (p[at] != "." or at > 5 and p[at - 6:at].isalpha()):
                seen.append(("o", m[1], ""))
        for m in _CAPITAL.finditer(p):
            at = m.start()
            if at > 1 and p[at - 1].isspace() and p[at - 2].isalpha():
                seen.append(("i", m[0], ""))
        for m in _STOP.finditer(p):
            if token := _token_before(p, m.start()):
                seen.append(("s", token, m[1] or ""))
    out.update(seen)


class Statistics:
    """Openers and abbreviations; picklable, of bounded size."""

    def __init__(self, openers: dict[str, float], stops: dict[str, tuple[float, float]]) -> None:
        self.openers, self.stops = openers, stops

    @classmethod
    def of(cls, counts: Counter) -> Statistics:
        """From counts of evidence(), for small corpora and tests."""
        opens = Counter({w: n for (k, w, _), n in counts.items() if k == "o"})
        inside = Counter({w: n for (k, w, _), n in counts.items() if k == "i"})
        openers = {w: n / (n + inside[w]) for w, n in opens.items()}
        stops: dict[str, list[int]] = {}
        for (k, a, b), n in counts.items():
            if k == "s":
                row = stops.setdefault(a, [0, 0, 0])
                row[0] += n
                row[1] += n * (b[:1].isupper() and openers.get(b, 0) >= OPENER)
                row[2] += n * b[:1].isupper()
        return cls(openers, {a: ((n - o) / (n + FEW), o / c if c > n * STRAY else 0.0) for a, (n, o, c) in stops.items()})


def _shut(p: str) -> list[tuple[int, int]]:
    if p.count('"') % 2:
        p = p.replace('"', "'")
    return [m.span() for m in _SHUT.finditer(p)]


class Document:
    """What a document says of its own words, from one pass over its unambiguous places; nothing is read before it is asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._words: set[str] | None = None
        self._places: dict[str, tuple[int, int]] = {}
        self._indexed: dict[str, list[int]] | None = None
        self._stops: dict[str, list] | None = None

    @property
    def words(self) -> set[str]:
        """All words as they are written, with the marks that follow them."""
        if self._words is None:
            self._words = set(self.text.split())
        return self._words

    def writes(self, word: str) -> bool:
        """Whether the document has a word without a full stop."""
        return word in self.words or f"{word}," in self.words

    def places(self, word: str) -> tuple[int, int]:
        """How often a word stands at an unambiguous beginning of a sentence, and how often inside one."""
        got = self._places.get(word)
        if got is None:
            if self._indexed is None and len(self.text) <= FEW_CHARACTERS:
                at, row = self.text.find(word), [0, 0]
                while at >= 0:
                    self._place(at, at + len(word), row)
                    at = self.text.find(word, at + 1)
                got = self._places[word] = (row[0], row[1])
            else:  # one pass for all words: the same counts, whatever the number of words that are asked for
                if self._indexed is None:
                    self._indexed = {}
                    for m in _WORD.finditer(self.text):
                        if not m[0].islower():
                            self._place(m.start(), m.end(), self._indexed.setdefault(m[0], [0, 0]))
                row = self._indexed.get(word, (0, 0))
                got = row[0], row[1]
        return got

    def _place(self, at: int, end: int, row: list[int]) -> None:
        t = self.text
        before = t[at - 1:at]
        if before.isalnum() or before in ("_", "-", "'", "’") and at or (c := t[end:end + 1]).isalnum() or c and c in "_'’-":
            return
        if before.isspace() and t[at - 2:at - 1].isalpha():
            row[1] += 1
            return
        k = at
        while k and t[k - 1] in "(\"“„«¿¡":
            k -= 1
        j = k
        while j and t[j - 1].isspace():
            j -= 1
        if not j or t.count("\n", j, k) > 1 or j < k and (t[j - 1] in "!?" or t[j - 1] == "." and j > 6 and t[j - 7:j - 1].isalpha()):
            row[0] += 1

    @property
    def stops(self) -> dict[str, list]:
        """Of words with a full stop, how often a sentence surely goes on behind it, and the capitalised words behind it."""
        if self._stops is None:
            held: dict[str, list] = {}
            text = self.text
            for m in _STOP.finditer(text):
                token, nxt = _token_before(text, m.start()), m[1] or ""
                if not token:
                    continue
                row = held.setdefault(token, [0, []])
                c = nxt[:1]
                if c in ",;:" or c.islower() or c.isdigit() and not token[-1].isdigit():
                    row[0] += 1
                elif c.isupper():
                    row[1].append(nxt)
            self._stops = held
        return self._stops

    def common(self, word: str) -> bool:
        """Whether the document writes a capitalised word in lower case and never capitalised inside a sentence, so that its capital tells of a beginning."""
        low = word.lower()
        return len(low) > 2 and low != word and self.writes(low) and not self.places(word)[1]

    def follows(self, token: str) -> tuple[int, int]:
        """How often a sentence surely goes on behind a word with a full stop, and how often one surely begins."""
        row = self.stops.get(token)
        if row is None:
            return 0, 0
        if not isinstance(row[1], int):
            row[1] = sum(map(self.common, row[1]))
        return row[0], row[1]

    def abbreviates(self, token: str, known: bool) -> bool | None:
        """Whether a word with a full stop is an abbreviation in the document, None if it doesn't say; known: the corpus knows it as one."""
        row = self.stops.get(token)
        if not known and (row is None or not row[0]):
            return None  # whatever else the document shows, it is none
        goes_on, ends = self.follows(token)
        if goes_on == 1 and self.writes(token):  # one place, and the word stands without a full stop elsewhere
            return None
        return None if goes_on == ends else goes_on > ends


def _is_opener(word: str, doc: Document, st: Statistics) -> float:
    """How surely a capitalised word opens a sentence: by the document's own occurrences, to which the corpus adds as much as PRIOR of them."""
    if doc.common(word):
        return 1.0
    starts, inside = doc.places(word)
    return (starts + PRIOR * st.openers.get(word, 0.0)) / (starts + inside + PRIOR)


def _token_before(p: str, dot: int) -> str:
    at = dot
    while at and p[at - 1] not in _NO_TOKEN:
        at -= 1
    return p[at:dot]


def _behind_figure(p: str, at: int) -> bool:
    while at and p[at - 1].isspace():
        at -= 1
    return at > 0 and p[at - 1].isdigit()


def _ends(p: str, dot: int, after: int, doc: Document, st: Statistics) -> bool:
    """Whether the full stop at dot ends a sentence; after: the first character that isn't a blank or closing mark behind it."""
    nxt = p[after]
    blank = p[after - 1].isspace()
    token = _token_before(p, dot)
    k = after
    while k < len(p) and p[k] in _OPEN:
        k += 1
    w = _WORD.match(p, k)
    word = w[0] if w else ""
    if not blank:
        if not (nxt.isupper() or nxt in "¿¡«„“\"(" or _EAST.match(nxt) or _IS_THAI.match(nxt)) or not token:
            return False
        if nxt in "\"(" and not word[:1].isupper():
            return False
        if nxt.isupper() and len(word) < 2 and not p[after + 1:after + 2].isspace():
            return False
        if len(token) == 1 and token.isupper() and p[k + len(word):k + len(word) + 1] == ".":
            return False
    if not token:
        return True
    if p[dot - 1] == ".":  # an ellipsis
        return bool(word) and (word[0].isupper() or st.openers.get(word, 0) >= OPENER)
    known = st.stops.get(token)
    by_corpus = known is not None and known[0] >= ABBREVIATION
    if len(token) == 1 and token.isalpha():
        said = not _behind_figure(p, dot - 1)  # a letter behind a figure is a unit, any other an initial
    elif "." in token[1:-1] and not token[-1].isdigit():
        said = True
    else:
        said = doc.abbreviates(token, by_corpus) if token.isalpha() or not _FIGURE.search(token) else False
    abbreviated = by_corpus if said is None else said
    if not word:
        if _FIGURE_EAST.match(p, after) and not _EAST.match(p, dot - 1):  # a figure in a sentence of another script
            return True
        if abbreviated and k < len(p) and p[k].isdigit():
            return False
        return not nxt.isdigit() and not (nxt in ",;:%)" or nxt in "–—-/=")
    if _EAST.match(word) or _IS_THAI.match(word):
        return True
    if word[0].islower() and st.openers.get(word, 0.0) < OPENER:
        return False
    if token[-1].isdigit():
        return not token.isdigit() or st.openers.get(word, 0.0) > 0 or doc.common(word)
    if abbreviated:
        sure = _is_opener(word, doc, st)
        goes_on, ended = doc.follows(token)
        ends = (ended + PRIOR * (known[1] if known else 0.0)) / (ended + goes_on + PRIOR)
        return sure >= OPENER and (ends >= ENDS or not known) or sure >= MAYBE and ends >= MOSTLY
    return True


def _boundaries(p: str, doc: Document, st: Statistics) -> list[int]:
    """Offsets in a paragraph at which a new sentence begins."""
    shut = _shut(p)
    cuts: list[int] = []
    k, start = 0, 0
    for m in _END.finditer(p):
        a, b = m.span()
        while k < len(shut) and shut[k][1] <= a:
            k += 1
        inside = k < len(shut) and shut[k][0] < a
        if inside:
            if b != shut[k][1] - 1:
                continue
            b = shut[k][1]
        else:
            b = _TAIL.match(p, b).end() if p[b:b + 1] in "'’)]" else b
        after = b
        while after < len(p) and p[after].isspace():
            after += 1
        if after >= len(p):
            break
        last = m[0][-1]
        nxt = p[after]
        if inside:
            opened = p[shut[k][0]]
            at_start = not p[start:shut[k][0]].strip()
            if opened in "(（":
                # a whole sentence in brackets, or a bracket at the end of one that has a terminator of its own
                if not at_start or nxt.islower():
                    continue
            elif last in _WIDE or _EAST.match(nxt):
                if at_start:
                    continue
            else:
                w = _WORD.match(p, after)
                if nxt in ",;:–—-" or (w and w[0][0].islower()):
                    continue
                if at_start and w and _is_opener(w[0], doc, st) < MAYBE:
                    continue
        elif last in _WIDE or last in "‼⁉":
            pass
        elif last in "!?":
            if after == b and not (nxt.isupper() or nxt in _OPEN or _EAST.match(nxt) or _IS_THAI.match(nxt)):
                continue
            if nxt in ",;:)–—":
                continue
        else:
            if a and p[a - 1].isdigit() and after == b and nxt.isdigit():
                continue
            if not _ends(p, b - 1 if p[b - 1] == "." else a + len(m[0]) - 1, after, doc, st):
                continue
        cuts.append(after)
        start = after
    if _IS_THAI.search(p):
        cuts += _thai(p)
    return sorted(set(cuts))


def _thai(p: str) -> list[int]:
    """Blanks between Thai letters, and places where Thai gives way to running text of another script."""
    out = [m.end() for m in re.finditer(r"(?<=[ก-๛])\s+(?=[ก-๛])", p)]
    for m in _FROM_THAI.finditer(p):
        nxt = _IS_THAI.search(p, m.end())
        run = p[m.end():nxt.start() if nxt else len(p)]
        if _EAST.match(run) or "Ѐ" <= run[0] <= "ӿ" or run[0] in "¿¡«„" or len(_LOWER_WORDS.findall(run)) >= 3:
            out.append(m.end())
    return out


def sentences(text: str | None, st: Statistics) -> list[tuple[int, int]]:
    """Half-open offsets of the sentences of a text, without blanks around them."""
    if not text:
        return []
    out = []
    doc = Document(text)
    for at, p in paragraphs(text):
        lead = len(p) - len(p.lstrip())
        p, at = p.strip(), at + lead
        if not p:
            continue
        if p[-1] not in _TERMINATORS and is_heading(p):
            out.append((at, at + len(p)))
            continue
        edges = [0, *_boundaries(p, doc, st), len(p)]
        for a, b in zip(edges, edges[1:]):
            piece = p[a:b].rstrip()
            if piece:
                out.append((at + a, at + a + len(piece)))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(list(total.values()), pa.int64())], ["kind", "word", "successor", "n"]
        )

    for b in batches:
        for t in b.column("text").to_pylist():
            if t:
                evidence(t, total)
        if len(total) > 200_000:
            yield flush()
            total.clear()
    if total:
        yield flush()


def corpus_statistics(documents: DataFrame) -> Statistics:
    """The statistics of all documents. Entries below the share LEAST of their kind are left to the document's own evidence."""
    c = documents.select("text").where("text is not null").mapInArrow(_count, "kind string, word string, successor string, n long")
    c = c.groupBy("kind", "word", "successor").agg(F.sum("n").alias("n")).persist()
    words = c.where("kind in ('o', 'i')").groupBy("word").agg(F.sum(F.when(F.col("kind") == "o", F.col("n")).otherwise(0)).alias("o"), F.sum("n").alias("n")).where("o > 0")
    total = words.agg(F.sum("o")).first()[0] or 0
    words = words.where(F.col("o") >= F.lit(total * LEAST))
    openers = {r[0]: r[1] for r in words.select("word", F.col("o") / F.col("n")).collect()}  # at most 1 / LEAST rows
    strong = words.where(F.col("o") / F.col("n") >= OPENER).select(F.col("word").alias("successor"), F.lit(1).alias("opens"))
    upper = F.substring("successor", 1, 1) != F.lower(F.substring("successor", 1, 1))
    stops = (
        c.where("kind = 's'").join(strong, "successor", "left")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(upper & F.col("opens").isNotNull(), F.col("n")).otherwise(0)).alias("o"), F.sum(F.when(upper, F.col("n")).otherwise(0)).alias("c"))
    )
    every = stops.agg(F.sum("n")).first()[0] or 0
    kept = stops.where(F.col("n") >= F.lit(every * LEAST)).where((F.col("n") - F.col("o")) / (F.col("n") + FEW) >= ABBREVIATION)
    abbreviations = {r[0]: ((r[1] - r[2]) / (r[1] + FEW), r[2] / r[3] if r[3] > r[1] * STRAY else 0.0) for r in kept.select("word", "n", "o", "c").collect()}  # at most 1 / LEAST rows
    c.unpersist()
    return Statistics(openers, abbreviations)


def split_documents(documents: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """doc_id, char_start, char_end of every sentence; with segments, of documents that have a segment of layout `para`."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("text is not null")
    if segments is not None:
        docs = docs.join(segments.where("layout = 'para'").select("doc_id").distinct(), "doc_id", "left_semi")
    sent = spark.sparkContext.broadcast(corpus_statistics(documents))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = sent.value
        for b in batches:
            ids, starts, ends = [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for x, y in sentences(t, st):
                    ids.append(d)
                    starts.append(x)
                    ends.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "char_start", "char_end"])

    return docs.mapInArrow(split, "doc_id long, char_start int, char_end int")
