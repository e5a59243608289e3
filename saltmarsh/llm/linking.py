"""Problem 3: freely written names mapped to the entries of a reference list.

Token-level repair: every distinct token is joined once to the tokens of the reference labels by edit distance, through
an index of deletion neighbourhoods over letter shapes (l, i and 1 are one shape), and by what linked mentions teach:
words that only decorate a name, and short forms. The repaired tokens then rank the entries by soft TF-IDF. Names of
salts are compared as sets of components, whose figures are never repaired. The score from which an entry is accepted
is fitted on all rows of the labelled table, which the workers score and of which only counts are collected.

The reference list is a fixed vocabulary; its size is checked, and beyond the bound the resolver refuses it. What linked
mentions teach is never cut: up to `MOST_SENT` words are sent to every worker, more are joined with the tokens of the
surfaces, with the same results.

Defined results: a null or blank surface gives no row; one that names nothing gives `none`; of equally good entries
preferred labels go before others, then the IRI decides; repeated rows give one result; an empty reference list gives
`none` everywhere.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.session import written

#: Entries a reference list may have to be sent to every worker.
MOST_ENTRIES = 200_000
#: Learnt words that are sent to every worker; more are joined with the tokens of the surfaces.
MOST_SENT = 5_000
#: Targets that a decorating word is seen with, and times that a short form is seen.
TARGETS, SEEN = 3, 3
#: Scores from which an entry may be accepted.
GRID = [x / 100 for x in range(40, 100)]

_SHAPE = str.maketrans({"i": "l", "1": "l", "|": "l", "!": "l", "0": "o"})
_TOKEN = re.compile(r"[^\W_]+\.?")
_FORMULA = re.compile(r"[a-z]{1,2}f\d?\Z")
_HYPHENS = re.compile(r"[‐‑‒–—―−-]")


#: Pairs of letters that look like another letter, and figures of a formula read as letters (fixed values).
_PAIRS = (("ii", "u"), ("rn", "m"), ("vv", "w"), ("cl", "d"))
_FIGURE = {",": "2", "z": "2", "s": "3", "8": "3", "q": "4", "a": "4", "h": "4"}
_MISREAD = re.compile(r"(?<![A-Za-z])([A-Za-z]{1,2}[Ff])([,zsqa8h])(?![A-Za-z0-9])")


def shape(word: str) -> str:
    for a, b in _PAIRS:
        if a in word:
            word = word.replace(a, b)
    return word.translate(_SHAPE)


def shapes(word: str) -> tuple[str, ...]:
    """The shapes of a word, with and without joining pairs of letters."""
    a, b = shape(word), word.translate(_SHAPE)
    return (a,) if a == b else (a, b)


def apart(a: str, b: str, most: int) -> int:
    """The least distance between shapes of two words."""
    return min(distance(x, y, most) for x in shapes(a) for y in shapes(b))


def tokens_of(text: str) -> list[str]:
    """Tokens in lower case; one that ends with a full stop keeps it, as it may be a short form."""
    t = unicodedata.normalize("NFKC", text)
    t = _HYPHENS.sub(" ", t).replace("'s ", " ").lower()
    return _TOKEN.findall(t)


def deletions(word: str, most: int) -> set[str]:
    out, level = {word}, {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1:] for w in level for i in range(len(w))}
        out |= level
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def allowed(word: str) -> int:
    """Edits that a word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def off(word: str, decoration: str) -> float:
    """Distance of a word to a decorating word as a share of its length; 1 if they are no misspellings of one another."""
    k = distance(shape(word), shape(decoration), allowed(decoration))
    return k / (len(decoration) + 1) if k <= allowed(decoration) else 1.0


class Reference:
    """The reference list with its indexes; picklable."""

    def __init__(self, rows: list[tuple[str, str | None, list[str] | None, str | None]], decorations: set[str] = frozenset(), aliases: dict[str, str] | None = None, accept: float = 0.8) -> None:
        self.entries: list[tuple[str, int, tuple[str, ...]]] = []
        self.squashed: dict[str, list[tuple[int, str]]] = defaultdict(list)
        self.salts: dict[frozenset, str] = {}
        self.components: dict[str, str] = {}
        self.decorations, self.aliases, self.accept = set(decorations), dict(aliases or {}), accept
        df: Counter = Counter()
        for iri, pref, alts, kind in sorted(rows, key=lambda r: r[0] or ""):
            if not iri:
                continue
            for rank, label in enumerate([pref, *(alts or [])]):
                if not label or not label.strip():
                    continue
                own = tuple(t.rstrip(".") for t in tokens_of(label))
                if not own:
                    continue
                if kind == "salt" and all(_FORMULA.match(t) for t in own):
                    self.salts.setdefault(frozenset(own), iri)
                    for t in own:
                        self.components[shape(t)] = t
                    continue
                self.entries.append((iri, min(rank, 1), own))
                self.squashed[shape("".join(own))].append((min(rank, 1), iri))
                df.update(set(own))
        n = max(1, len(self.entries))
        self.idf = {t: math.log(1 + n / k) for t, k in df.items()}
        self.most = math.log(1 + n)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for k, (_, _, own) in enumerate(self.entries):
            for t in set(own):
                self.by_token[t].append(k)
        self.near: dict[str, set[str]] = defaultdict(set)
        self.shapes: dict[str, str] = {}
        for t in df:
            for q in shapes(t):
                self.shapes.setdefault(q, t)
                for d in deletions(q, allowed(t)):
                    self.near[d].add(t)
        self.in_order = sorted((shape(t), t) for t in df)
        self.beside: dict[str, set[str]] = defaultdict(set)
        self.longest = max((len(shape(d)) for d in self.decorations), default=0)
        for w in self.decorations:
            if len(w) >= 4:
                for d in deletions(shape(w), allowed(w)):
                    self.beside[d].add(w)
        self.told: dict[str, float] | None = None
        self.held: dict[str, list[tuple[str, float]]] = {}
        self.answers: dict[str, tuple[str | None, float]] = {}
        self.adorned: dict[str, bool] = {}
        self.whole: dict[str, set[str]] = defaultdict(set)
        for q in self.squashed:
            for d in deletions(q, 2 if len(q) >= 8 else 0):
                self.whole[d].add(q)

    def repair(self, token: str) -> list[tuple[str, float]]:
        """Reference tokens that a token may stand for, with their likeness."""
        got = self.held.get(token)
        if got is None:
            got = self.held[token] = self._repair(token)
            if len(self.held) > 200_000:
                self.held.clear()
        return got

    def _repair(self, token: str) -> list[tuple[str, float]]:
        t = token.rstrip(".")
        if t in self.idf:
            return [(t, 1.0)]
        if t in self.aliases:
            return [(self.aliases[t], 0.97)]
        forms, bare = [t], t
        while bare.endswith("s") and len(bare) > 3:
            if bare.endswith("ies") and len(bare) > 4:
                forms.append(bare[:-3] + "y")
            if bare.endswith("es") and len(bare) > 4:
                forms.append(bare[:-2])
            bare = bare[:-1]
            forms.append(bare)
        for f in forms[1:]:
            if f in self.idf:
                return [(f, 0.99)]
        for f in forms:
            for q in shapes(f):
                if q in self.shapes:
                    return [(self.shapes[q], 0.97)]
        out: dict[str, float] = {}
        for f in forms:
            most = allowed(f)
            if not most:
                continue
            for w in {w for q in shapes(f) for d in deletions(q, most) for w in self.near.get(d, ())}:
                k = apart(f, w, most)
                if k <= most and k <= allowed(w):
                    out[w] = max(out.get(w, 0.0), 1 - k / (max(len(f), len(w)) + 1))
        if token.endswith(".") and len(t) >= 3:
            begin = shape(t)  # a short form: words that begin with it lie together
            for k in range(bisect.bisect_left(self.in_order, (begin,)), len(self.in_order)):
                q, w = self.in_order[k]
                if not q.startswith(begin):
                    break
                if len(w) > len(t) + 1:
                    out[w] = max(out.get(w, 0.0), 0.9)
        return sorted(out.items(), key=lambda x: (-x[1], x[0]))

    def loose(self, token: str, word: str) -> float:
        """Likeness of a token to a word that its neighbours make likely; 0 if it has none."""
        t = token.rstrip(".")
        if len(t) < 2 or len(word) < 3:
            return 0.0
        most = allowed(word) + 1
        k = apart(t, word, most)
        return 1 - k / (max(len(t), len(word)) + 1) if k <= most else 0.0

    def tell(self, words: list[dict]) -> None:
        """What was learnt of the tokens of the next surface, where it isn't sent out whole."""
        if self.told is None or len(self.told) > 200_000:
            self.told, self.decorations, self.aliases = {}, set(), {}
        for w in words:
            if w["decorates"]:
                self.decorations.add(w["word"])
            if w["alias"]:
                self.aliases[w["word"]] = w["alias"]
            self.told[w["word"]] = 1.0 if w["off"] is None else w["off"]

    def nearest(self, t: str) -> float:
        """Distance to the nearest decorating word as a share of its length; 1 if none is near."""
        if self.told is not None:
            return self.told.get(t, 1.0)
        q = shape(t)
        if len(q) > self.longest + 2:
            return 1.0
        return min((off(t, w) for w in {w for d in deletions(q, 2) for w in self.beside.get(d, ())}), default=1.0)

    def decorates(self, token: str) -> bool:
        """Whether a token is a decorating word, perhaps misspelt or in the plural."""
        t = token.rstrip(".")
        if t in self.decorations or t.rstrip("s") in self.decorations:
            return True
        got = self.adorned.get(t)
        if got is None:
            got = False
            if len(t) >= 5 and not any(p >= 0.9 for _, p in self.repair(token)):
                likely = max((p for _, p in self.repair(token)), default=0.0)
                near = self.nearest(t)
                got = near < 1.0 and 1 - near >= likely
            self.adorned[t] = got
            if len(self.adorned) > 200_000:
                self.adorned.clear()
        return got

    def tokens_in(self, surface: str) -> list[str]:
        """Tokens of a surface, figures of its formulas read as such."""
        surface = _MISREAD.sub(lambda m: f"{m[1]}{_FIGURE[m[2]]} " if shape(m[1].lower()) not in self.components else m[0], unicodedata.normalize("NFKC", surface))
        return tokens_of(surface)

    def components_of(self, tokens: list[str]) -> tuple[set[str], list[str], bool]:
        """(components, other tokens, whether one is an unknown formula)."""
        parts, rest, strange = set(), [], False
        for t in tokens:
            w = t.rstrip(".")
            c = self.components.get(shape(w))
            if c:
                parts.add(c)
            elif _FORMULA.match(w) and w[-1].isdigit():
                strange = True
            else:
                rest.append(t)
        return parts, rest, strange

    def rank(self, tokens: list[str]) -> list[tuple[float, int, str]]:
        """(score, rank of the label, IRI) of entries sharing a token, best first, by soft TF-IDF."""
        fixed = [self.repair(t) for t in tokens]
        seen = {k for r in fixed for w, _ in r for k in self.by_token[w]}
        out = []
        for k in seen:
            iri, rank, own = self.entries[k]
            left = Counter(own)
            got, norm, over = 0.0, 0.0, []
            for t, r in zip(tokens, fixed):
                hit = next(((w, p) for w, p in r if left[w] > 0), None)
                if hit:
                    left[hit[0]] -= 1
                    x = self.idf[hit[0]] ** 2
                    got += hit[1] * x
                    norm += x
                else:
                    over.append((t, r))
            for t, r in over:  # what is left may stand for what is missing, with an edit more
                w, p = max(((w, self.loose(t, w)) for w, n in left.items() if n > 0), key=lambda x: x[1], default=("", 0.0)) if not r or r[0][1] < 0.96 else ("", 0.0)
                if p:
                    left[w] -= 1
                    x = self.idf[w] ** 2
                    got += p * x
                    norm += x
                else:
                    norm += (self.idf[r[0][0]] if r else self.most) ** 2
            full = sum(self.idf[w] ** 2 for w in own)
            out.append((got / math.sqrt(norm * full) if norm and full else 0.0, rank, iri))
        return sorted(out, key=lambda x: (-round(x[0], 9), x[1], x[2]))

    def best(self, surface: str) -> tuple[str | None, float]:
        """The entry a surface names best and its score, before acceptance."""
        tokens = self.tokens_in(surface)
        parts, rest, strange = self.components_of(tokens)
        if len(parts) + strange >= 2 or strange or parts and not any(t.rstrip(".") in self.idf for t in rest):
            return (self.salts.get(frozenset(parts)) if not strange else None), 1.0
        while len(tokens) > 1:  # words that decorate a name are dropped, but never all of it
            extra = [t for t in tokens if self.decorates(t)]
            if not extra or len(extra) == len(tokens):
                break
            tokens = [t for t in tokens if not self.decorates(t)]
        whole = shape("".join(t.rstrip(".") for t in tokens))
        if whole in self.squashed:
            return min(self.squashed[whole])[1], 1.0
        got = self.rank(tokens)
        iri, score = (got[0][2], got[0][0]) if got else (None, 0.0)
        if score < 0.9 and len(whole) >= 8:  # blanks may be lost or misplaced
            near = [(distance(whole, q, 2), q) for q in {q for d in deletions(whole, 2) for q in self.whole.get(d, ())}]
            near = [(k, q) for k, q in near if k <= 2]
            if near:
                k, q = min(near)
                if 1 - k / len(q) > score:
                    return min(self.squashed[q])[1], 1 - k / len(q)
        return iri, score

    def scored(self, surface: str) -> tuple[str | None, float]:
        """`best`, remembered."""
        answer = self.answers.get(surface)
        if answer is None:
            answer = self.answers[surface] = self.best(surface)
            if len(self.answers) > 200_000:
                self.answers.clear()
        return answer

    def resolve(self, surface: str) -> str:
        iri, score = self.scored(surface)
        return iri if iri and score >= self.accept else "none"

    def unexplained(self, surface: str, iri: str, labels: dict[str, list[tuple[str, ...]]]) -> Iterator[tuple[str, str]]:
        """(token, label token or '') of the tokens of a linked surface that repair doesn't explain: decorations and short forms."""
        tokens = self.tokens_in(surface)
        parts, rest, _ = self.components_of(tokens)
        if len(parts) >= 2:
            yield from ((t.rstrip("."), "") for t in rest)
            return
        best = None
        for own in labels.get(iri, ()):
            left, extra = Counter(own), []
            for t in tokens:
                hit = next((w for w, _ in self.repair(t) if left[w] > 0), None)
                if hit:
                    left[hit] -= 1
                else:
                    extra.append(t.rstrip("."))
            missing = [w for w, n in left.items() if n > 0]
            if len(missing) < len(own) and (best is None or len(missing) + len(extra) < best[0]):
                best = (len(missing) + len(extra), missing, extra)
        if best:
            _, missing, extra = best
            if not missing:
                yield from ((t, "") for t in extra)
            elif len(missing) == 1 and len(extra) == 1 and extra[0][0] == missing[0][0]:
                yield extra[0], missing[0]


def reference_rows(concepts: DataFrame) -> list[tuple]:
    n = concepts.count()
    if n > MOST_ENTRIES:
        raise ValueError(f"a reference list of {n} entries is too large to be sent to every worker; the bound is {MOST_ENTRIES}")
    return [tuple(r) for r in concepts.select("target_iri", "pref_label", "alt_labels", "target_kind").distinct().collect()]


def learn(mentions: DataFrame, rows: list[tuple]) -> DataFrame:
    """token, decorates, alias: all decorating words and short forms of all linked mentions, one row a token."""
    spark = mentions.sparkSession
    labels: dict[str, list] = defaultdict(list)
    for iri, pref, alts, _ in rows:
        labels[iri] += [tuple(t.rstrip(".") for t in tokens_of(x)) for x in [pref, *(alts or [])] if x]
    sent = spark.sparkContext.broadcast((Reference(rows), dict(labels)))  # the reference list, of checked size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, by_iri = sent.value
        held: Counter = Counter()
        for b in batches:
            pairs = Counter(zip(b.column("surface_form").to_pylist(), b.column("target_iri").to_pylist()))
            for (s, iri), n in pairs.items():
                for token, label in ref.unexplained(s, iri, by_iri):
                    held[token, label, iri] += n
        keys = list(held)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(held.values()), pa.int64())], ["token", "label", "target", "n"])

    linked = mentions.where("status = 'linked' and target_iri is not null and surface_form is not null").select("surface_form", "target_iri")
    c = linked.mapInArrow(run, "token string, label string, target string, n long").groupBy("token", "label").agg(F.sum("n").alias("n"), F.count_distinct("target").alias("targets"))
    adorns = (F.col("label") == "") & (F.col("targets") >= TARGETS) & (F.col("n") >= TARGETS)
    stands = (F.col("label") != "") & (F.col("n") >= SEEN)
    c = c.where(adorns | stands).groupBy("token").agg(F.max(adorns).alias("decorates"), F.max(F.when(stands, F.struct("n", "label"))).alias("most"))
    return c.select("token", "decorates", F.when(~F.col("decorates"), F.col("most.label")).alias("alias"))


def accepting(counts: dict[tuple[int, bool, bool], int], default: float) -> float:
    """The acceptance score with the fewest errors; of equal ones the middle. Counted are labelled rows by the number of
    scores in GRID that their best entry reaches, whether it is the right one, and whether there is a right one."""
    errors = [sum(n * (not right if i < k else named) for (k, right, named), n in counts.items()) for i in range(len(GRID))]
    same = [g for g, e in zip(GRID, errors) if e == min(errors)]
    return same[len(same) // 2] if counts else default


def fit(ref: Reference, gold: list[tuple[str, str | None]]) -> float:
    """The acceptance score of a list of labelled surfaces."""
    scored = [(ref.best(s), want) for s, want in gold if s and s.strip()]
    return accepting(Counter((bisect.bisect_right(GRID, score), iri == want, want is not None) for (iri, score), want in scored), ref.accept)


def fitted(scored: DataFrame, default: float) -> float:
    """The acceptance score of all labelled rows; `key` is the right entry. Of them only counts are collected."""
    reached = F.size(F.filter(F.array(*map(F.lit, GRID)), lambda g: g <= F.col("score")))
    counts = scored.groupBy(reached.alias("k"), F.col("iri").eqNullSafe(F.col("key")).alias("right"), F.col("key").isNotNull().alias("named")).agg(F.count("*").alias("n"))
    return accepting({(r["k"], r["right"], r["named"]): r["n"] for r in counts.collect()}, default)  # at most 4 rows a score


def scored_by_sent(df: DataFrame, sent: Broadcast) -> DataFrame:
    """key, iri, score of the rows (key, surface), by a resolver that holds all learnt words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = sent.value
        for b in batches:
            answers = [ref.scored(s) for s in b.column("surface").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64())], ["key", "iri", "score"])

    return df.select("key", "surface").mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, iri string, score double")


def near_decorations(words: DataFrame, decorations: DataFrame) -> DataFrame:
    """word, off: distance of words to their nearest decorating word, found by a join of deletion neighbourhoods."""
    longest = decorations.agg(F.max(F.length("token"))).first()[0] or 0

    def keys(least: int, longest: float, most: Callable[[str], int], name: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = [(k, w) for w in b.column(0).to_pylist() if len(w) >= least and len(shape(w)) <= longest for k in deletions(shape(w), most(w))]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in range(2)], ["key", name])

        return run

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offs = [off(w, t) for w, t in zip(b.column("word").to_pylist(), b.column("token").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(offs, pa.float64())], ["word", "off"])

    asked = words.select("word").mapInArrow(keys(5, longest + 2, lambda w: 2, "word"), "key string, word string")
    known = decorations.select("token").mapInArrow(keys(4, math.inf, allowed, "token"), "key string, token string")
    pairs = asked.join(known, "key").select("word", "token").distinct()
    return pairs.mapInArrow(apart, "word string, off double").where("off < 1").groupBy("word").agg(F.min("off").alias("off"))


def scored_by_join(df: DataFrame, sent: Broadcast, learnt: DataFrame) -> DataFrame:
    """key, iri, score of the rows (key, surface), where the resolver holds no learnt words: those of each surface are joined to it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = sent.value
        for b in batches:
            pairs = [(s, w) for s in b.column("surface").to_pylist() for w in {t.rstrip(".") for t in ref.tokens_in(s)}]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in range(2)], ["surface", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = sent.value
        for b in batches:
            answers = []
            for s, words in zip(b.column("surface").to_pylist(), b.column("words").to_pylist()):
                ref.tell(words or [])
                answers.append(ref.best(s))
            yield pa.RecordBatch.from_arrays([b.column("surface"), pa.array([a[0] for a in answers], pa.string()), pa.array([a[1] for a in answers], pa.float64())], ["surface", "iri", "score"])

    surfaces = df.select("surface").distinct()
    held = written(surfaces.mapInArrow(split, "surface string, word string"), "words")
    words = held.select("word").distinct()
    decorations = learnt.where("decorates")
    stems = decorations.select(F.col("token").alias("stem"))
    words = words.join(learnt.withColumnRenamed("token", "word"), "word", "left").withColumn("stem", F.expr("trim(trailing 's' from word)")).join(stems.withColumn("plural", F.lit(True)), "stem", "left")
    words = words.join(near_decorations(held.select("word").distinct(), decorations), "word", "left")
    words = words.select("word", F.coalesce("decorates", "plural", F.lit(False)).alias("decorates"), "alias", "off")
    by_surface = held.join(words.where("decorates or alias is not null or off is not null"), "word").groupBy("surface").agg(F.collect_list(F.struct("word", "decorates", "alias", "off")).alias("words"))
    answers = surfaces.join(by_surface, "surface", "left").mapInArrow(run, "surface string, iri string, score double")
    return df.join(answers, "surface").select("key", "iri", "score")


def trained(mentions: DataFrame, concepts: DataFrame, most_sent: int = MOST_SENT) -> tuple[Reference, Callable[[DataFrame], DataFrame]]:
    """The resolver, and what scores rows (key, surface) by it and by all learnt words."""
    context = mentions.sparkSession.sparkContext
    rows = reference_rows(concepts)
    learnt = learn(mentions, rows).persist()
    if learnt.count() > most_sent:
        kept = written(learnt, "learnt")
        learnt.unpersist()
        ref = Reference(rows)
        sent = context.broadcast(ref)  # the reference list, of checked size
        return ref, lambda df: scored_by_join(df, sent, kept)
    few = learnt.collect()  # at most `most_sent` rows
    learnt.unpersist()
    ref = Reference(rows, {r["token"] for r in few if r["decorates"]}, {r["token"]: r["alias"] for r in few if r["alias"]})
    sent = context.broadcast(ref)  # the reference list and the learnt words, of checked sizes
    return ref, lambda df: scored_by_sent(df, sent)


def link_novel(mentions: DataFrame, concepts: DataFrame, gold: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """mention_id, target_iri of every novel mention with a surface; `none` where it names no entry."""
    ref, score = trained(mentions, concepts, most_sent)
    named = F.regexp_replace("surface", "[\\s\\u00a0]+", "") != ""
    labelled = gold.select("gold_id", "surface", F.col("expected_target_iri").alias("key")).distinct().where(named)
    accept = fitted(score(labelled), ref.accept)
    novel = mentions.where("status = 'novel'").select(F.col("mention_id").alias("key"), F.col("surface_form").alias("surface")).where(named)
    answer = F.when(F.col("score") >= accept, F.col("iri"))
    return score(novel).select(F.col("key").alias("mention_id"), F.coalesce(answer, F.lit("none")).alias("target_iri")).distinct()
