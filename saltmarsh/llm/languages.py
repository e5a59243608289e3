"""Problem 9: the language of every document and of every stretch of a document in several languages.

Character models with interpolated Kneser-Ney smoothing, one a language, are trained on words of labelled documents
(a bounded sample, cleaned once by the models themselves) and kept as sorted arrays of n-gram hashes with log
probabilities, found by binary search. Distinct words are scored once a worker. The sentences of a document get their
cross-entropy under every model; Viterbi with a cost for each change gives the stretches. A stretch is `und` when it
has no words, or when its length-normalised cross-entropy under the best model is rejected. The rejection is calibrated
on sample sentences that were kept back: their cross-entropy has a mean and a variance a + b / letters for each
language, and the limit is the standardised excess that a text of the language passes with the probability REJECTED, by
an exponential tail fitted to the kept-back sentences and documents. The confidence is the softmax of the scores at a
temperature fitted on the same sentences.

Defined results: null and blank texts have no language and give no row; a text without words is `und`; lines of page
matter, names with figures, formulas and units take no part; texts are read whole; repeated rows give one result; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm import sentences as S
from saltmarsh.llm.scans import Matter, learn_matter

#: Language codes with the names and codes that stand for them in labels.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglês",
    "de": "de deu ger german deutsch allemand alemán aleman",
    "fr": "fr fra fre french français francais französisch francés frances",
    "es": "es spa spanish español espanol castellano castilian espagnol spanisch",
    "pt": "pt por portuguese português portugues portugiesisch portugais",
    "ru": "ru rus russian русский russe russisch",
    "uk": "uk ukr ukrainian українська украинский ukrainisch",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 chinois chinesisch",
    "ja": "ja jpn jp japanese 日本語 japonais japanisch",
    "th": "th tha thai ไทย ภาษาไทย",
    "und": "und",
}
#: Common words that make a model for a language of which no document is labelled.
SEEDS = {
    "en": "the of and to in is was that for it with as on be at by this had not are but from or have an they which one were all there would their",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec été aux mais comme ou si leur entre après",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha sin sobre este ya entre cuando todo esta ser",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já",
    "ru": "и в не на я что тот быть с а весь это как она по но они к у ты из мы за вы так же от сказать этот который мочь человек о один ещё бы такой только было при после для",
    "uk": "і в не на я що той бути з а весь це як вона по але вони до у ти із ми за ви так же від цей який могти людина про один ще би такий тільки було після для під час",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出 会 可 也 你 对 生 能 而 子 那 得 于 着 下 自 之",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による",
    "th": "ที่ และ ใน เป็น การ ของ มี ให้ ได้ จะ ไม่ ว่า กับ ไป มา นี้ ก็ คน หรือ จาก ถูก แต่ โดย อยู่ เมื่อ ทำ ความ หลัง ขึ้น แล้ว",
}
#: The sample the models are trained on: labelled documents a language, sentences a document and words a sentence,
#: evenly spaced, letters a word. It bounds what the driver holds; every document is judged whole.
SAMPLE, SENTENCES, WORDS, LETTERS = 400, 60, 400, 64
#: Longest n-gram, discount, letters that share the uniform base.
ORDER, DISCOUNT, ALPHABET = 5, 0.75, 3000
#: Cost in nats of a change of language between sentences.
CHANGE = 9.0
#: Probability that a text of a language is rejected as none, and the share of kept-back texts that make the fitted tail.
REJECTED, TAIL = 1e-6, 0.05
#: Words a worker remembers.
MOST_HELD = 400_000
#: Letters that a text of some language has at least.
FEWEST = 6

_CODES = {n: code for code, names in NAMES.items() for n in names.split()}
_TOKEN = re.compile(r"(?<![\w/])(?:[^\W\d_฀-๿぀-ヿㇰ-ㇿ㐀-鿿ｦ-ﾟ]+(?:['’][^\W\d_]+)*(?![\w/]|-\d)|[฀-๿]+|[぀-ヿㇰ-ㇿ㐀-鿿ｦ-ﾟ々]+)|[฀-๿]+|[぀-ヿㇰ-ㇿ㐀-鿿ｦ-ﾟ々]+")
#: The same for ASCII texts.
_ASCII_TOKEN = re.compile(r"(?<![\w/])[A-Za-z]+(?:'[A-Za-z]+)*(?![\w/]|-\d)", re.ASCII)
#: Every place where a sentence may end.
_MAY_END = re.compile(r"[.!?…。！？．｡‼⁉]+(?![\d,;])|\n[ \t\r\x0b\f]*\n|(?<=[ก-๛])\s+")
_SCAN = re.compile(f"{_TOKEN.pattern}|{_MAY_END.pattern}")
_ASCII_SCAN = re.compile(f"{_ASCII_TOKEN.pattern}|[.!?]+(?![\\d,;])|\\n[ \\t\\r\\x0b\\f]*\\n", re.ASCII)
#: What a match of _SCAN is if it is no word with a row.
_END, _NO_WORD, _NEW = -1, -2, -3
_BASE = np.uint64(1099511628211)


def label_code(label: str | None) -> str | None:
    """The language that a label names in any form, or None."""
    if not label:
        return None
    t = label.strip().lower()
    return _CODES.get(t) or _CODES.get(re.split(r"[-_ ]", t)[0] if t else "")


class _Forms(dict):
    """Words in lower case by their written form; None for formulas, acronyms and single capitals. Of bounded size."""

    def __missing__(self, w: str) -> str | None:
        if len(self) > MOST_HELD:
            self.clear()
        word = w.islower() or not w[0].isascii() and not w[0].isupper() or w[1:].islower() or (w[1:2] in "'’" and not w[2:].isupper() and len(w) > 2)
        got = self[w] = w.lower() if word else None
        return got


_FORMS = _Forms()


def words_of(text: str) -> list[str]:
    """Words in lower case; formulas, acronyms and single capitals are no words."""
    return [w for t in (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text) if (w := _FORMS[t])]


def without_page_matter(text: str, report: str | None, matter: Matter) -> str:
    """text with running headers, footers and page numbers blanked; offsets stay."""
    if "\f" not in text and "\n" not in text:
        return text
    out, at = list(text), 0
    pages = text.split("\f")
    for page in pages:
        lines = page.split("\n")
        off = matter.lines(lines, report, False)
        if off:
            pos = at
            for i, line in enumerate(lines):
                if i in off:
                    out[max(0, pos - 1):pos + len(line) + 1] = " " * (len(out[max(0, pos - 1):pos + len(line) + 1]))
                pos += len(line) + 1
        at += len(page) + 1
    return "".join(out).replace("\f", " ")


class Language:
    """A character model: for every order sorted n-gram hashes with log probabilities, sorted context hashes with log back-off weights."""

    def __init__(self, words: dict[str, int]) -> None:
        counts: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for w, n in words.items():
            s = f"\x02{w}\x03"
            for i in range(1, len(s)):
                for k in range(1, min(ORDER, i + 1) + 1):
                    counts[k][s[i - k + 1:i + 1]] += n
        # below the longest order, an n-gram counts the letters that precede it, unless it opens the word
        for k in range(ORDER - 1, 0, -1):
            before = Counter(g[1:] for g in counts[k + 1])
            counts[k] = Counter({g: (n if g[0] == "\x02" else before[g] or n) for g, n in counts[k].items()})
        lower = {"": 1.0 / ALPHABET}
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.backs: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, ORDER + 1):
            total, kinds = Counter(), Counter()
            for g, n in counts[k].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            back = {h: DISCOUNT * kinds[h] / total[h] for h in total}
            probs = {}
            for g, n in counts[k].items():
                h = g[:-1]
                low = lower.get(g[1:] if k > 1 else "")
                if low is None:
                    low = 1.0 / ALPHABET
                probs[g] = max(n - DISCOUNT, 0.0) / total[h] + back[h] * low
            self.grams.append(_sorted(probs))
            self.backs.append(_sorted(back))
            lower = probs

    def score(self, hashes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Log probability of each of n letters; hashes: of each order the positions, n-grams and contexts."""
        out = np.full(n, -math.log(ALPHABET), dtype=np.float32)
        for (at, grams, contexts), (g, p), (c, b) in zip(hashes, self.grams, self.backs):
            if not len(at) or not len(g):
                continue
            i = np.minimum(np.searchsorted(g, grams), len(g) - 1)
            found = g[i] == grams
            j = np.minimum(np.searchsorted(c, contexts), len(c) - 1)
            weight = np.where(c[j] == contexts, b[j], np.float32(0))
            out[at] = np.where(found, p[i], out[at] + weight)
        return out


@lru_cache(1_000_000)
def _hash(text: str) -> int:
    h = 1469598103934665603
    for ch in text:
        h = (h * 1099511628211 + ord(ch)) & 0xFFFFFFFFFFFFFFFF
    return h


def _sorted(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([_hash(g) for g in values], dtype=np.uint64)
    logs = np.log(np.array(list(values.values()), dtype=np.float64)).astype(np.float32)
    order = np.argsort(keys)
    return keys[order], logs[order]


def _hashes(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, int]:
    """For each order the positions, n-gram hashes and context hashes of all letters of the words; starts of words; letters."""
    flat = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(starts, size)
    out = []
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            at = np.flatnonzero((place >= 1) & (place >= k - 1))
            h = np.full(len(at), 1469598103934665603, dtype=np.uint64)
            c = h
            for j in range(k - 1, -1, -1):
                c = h
                h = h * _BASE + codes[at - j]
            out.append((at, h, c))
    return out, starts, len(codes)


class Models:
    """Models of all languages, the temperature of the confidence and the calibration of the rejection."""

    def __init__(self, words: dict[str, Counter]) -> None:
        self.codes = sorted(words)
        self.models = [Language(words[c]) for c in self.codes]
        self.temperature = 0.3
        #: Mean and variance terms (a, b) of the cross-entropy of each language; tail: where it begins, its mean excess, the limit.
        self.spread: dict[str, tuple[float, float, float]] = {}
        self.tail: tuple[float, float, float] | None = None
        self.forget()

    def coded(self, tokens: list[str]) -> np.ndarray:
        """For each match of _SCAN the row of its word in the table, _END for what may end a sentence, _NO_WORD for formulas and the like."""
        find = lambda: np.fromiter(map(self.codes_of.get, tokens, itertools.repeat(_NEW)), dtype=np.int64, count=len(tokens))
        got = find()
        new = np.flatnonzero(got == _NEW)
        if len(new):
            fresh = {tokens[k] for k in new.tolist()}
            forms = {t: _FORMS[t] if t[0].isalpha() or t[0].isalnum() or _TOKEN.match(t) else _END for t in fresh}
            words = {f for f in forms.values() if isinstance(f, str)}
            if len(self.rows) + len(words) > MOST_HELD or len(self.codes_of) > 4 * MOST_HELD:  # rows change their places, so all tokens are looked up anew
                self.forget()
                fresh = set(tokens)
                forms = {t: _FORMS[t] if t[0].isalpha() or t[0].isalnum() or _TOKEN.match(t) else _END for t in fresh}
                words = {f for f in forms.values() if isinstance(f, str)}
            self.learn(words)
            self.codes_of.update((t, _NO_WORD if f is None else f if f == _END else self.rows[f]) for t, f in forms.items())
            got = find()
        return got

    def forget(self) -> None:
        self.codes_of: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.codes)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def learn(self, words: set[str]) -> None:
        """Score words that are new to this worker."""
        if len(self.rows) + len(words) > MOST_HELD:
            self.forget()
        new = [w for w in words if w not in self.rows]
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            hashes, starts, n = _hashes(part)
            scores = np.stack([np.add.reduceat(m.score(hashes, n), starts) for m in self.models], axis=1)
            # the opening mark is no prediction
            scores += np.float32(math.log(ALPHABET))
            self.rows.update(zip(part, range(len(self.table), len(self.table) + len(part))))
            self.table = np.concatenate([self.table, scores.astype(np.float32)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, part), dtype=np.int64, count=len(part))])

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each list of words under every model, and the predictions it takes (letters and word ends)."""
        n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        out, size = np.zeros((len(texts), len(self.codes))), np.zeros(len(texts), dtype=np.int64)
        words = list(itertools.chain.from_iterable(texts))
        if not words:
            return out, size
        find = lambda: np.fromiter(map(self.rows.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        at = find()
        if (at < 0).any():
            self.learn(set(words))
            at = find()
        some = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[some]
        out[some] = np.add.reduceat(self.table[at], starts, axis=0, dtype=np.float64)
        size[some] = np.add.reduceat(self.letters[at], starts) + n[some]
        return out, size

    def confidence(self, score: np.ndarray, best: int) -> float:
        z = (score - score[best]) * self.temperature
        return float(1.0 / np.exp(np.minimum(z, 30)).sum())

    def calibrate(self, held: list[tuple[int, str, float, int]]) -> None:
        """From (document, language, log probability, predictions) of kept-back sentences."""
        for c in self.codes:
            own = [(-s / n, n) for _, code, s, n in held if code == c]
            if len(own) < 20:
                continue
            h, n = (np.array(x, dtype=np.float64) for x in zip(*own))
            mean = float(np.average(h, weights=n))
            sq, x = (h - mean) ** 2, 1.0 / n
            b = float(max(0.0, np.cov(x, sq)[0, 1] / max(x.var(), 1e-12)))
            a = float(max(1e-4, sq.mean() - b * x.mean()))
            self.spread[c] = mean, a, b
        whole: dict[tuple[int, str], list[float]] = {}
        for doc, code, s, n in held:
            row = whole.setdefault((doc, code), [0.0, 0])
            row[0] += s
            row[1] += n
        z = [self.excess(-s / n, n, code) for _, code, s, n in held] + [self.excess(-s / n, n, code) for (_, code), (s, n) in whole.items()]
        z = np.array([x for x in z if x is not None])
        if len(z) >= 100:
            begin = float(np.quantile(z, 1 - TAIL))
            mean = float((z[z > begin] - begin).mean()) if (z > begin).any() else 1.0
            self.tail = begin, mean, begin + mean * math.log(TAIL / REJECTED)

    def excess(self, entropy: float, n: int, code: str) -> float | None:
        """Standardised excess of a text's length-normalised cross-entropy; None where the language wasn't calibrated."""
        got = self.spread.get(code)
        return None if got is None else (entropy - got[0]) / math.sqrt(got[1] + got[2] / n)

    def rejection(self, score: float, n: int, code: str) -> float | None:
        """The confidence that a text is in no language, None if it isn't rejected."""
        z = self.excess(-score / n, n, code) if self.tail else None
        if z is None or z <= self.tail[2]:
            return None
        return 1.0 - 0.5 * math.exp(-(z - self.tail[2]) / self.tail[1])

    def named(self, row: np.ndarray, n: int, code: int) -> tuple[str, float]:
        """The language of a text whose best model is `code`, or `und`, with the confidence."""
        none = self.rejection(row[code], n, self.codes[code])
        return ("und", none) if none is not None else (self.codes[code], self.confidence(row, code))


def _units(clean: str, st: S.Statistics) -> tuple[list[tuple[int, int]], list[list[str]]]:
    spans = S.sentences(clean, st)
    return spans, [words_of(clean[a:b]) for a, b in spans]


def _path(scores: np.ndarray) -> list[int]:
    """The language of each sentence by Viterbi with the cost CHANGE."""
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - CHANGE
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - CHANGE) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def stretches(spans: list[tuple[int, int]], words: list[list[str]], scores: np.ndarray, sizes: np.ndarray, m: Models) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the stretches of one language in a document whose sentences are spans."""
    use = [i for i, w in enumerate(words) if w]
    scores, sizes = scores[use], sizes[use]
    out: list[list] = []
    for k, (i, code) in enumerate(zip(use, _path(scores))):
        if out and out[-1][2] == code:
            out[-1][1], out[-1][4] = spans[i][1], k + 1
        else:
            out.append([spans[i][0] if out else 0, spans[i][1], code, k, k + 1])
    out[-1][1] = spans[-1][1]
    got: list[tuple[int, int, str, float]] = []
    for a, b, code, x, y in out:
        lang, sure = m.named(scores[x:y].sum(axis=0), int(sizes[x:y].sum()), code)
        if got and got[-1][2] == lang:
            got[-1] = got[-1][0], b, lang, min(got[-1][3], sure)
        else:
            got.append((a, b, lang, sure))
    return got


def judge(texts: list[str], m: Models, st: S.Statistics) -> list[list[tuple[int, int, str, float]]]:
    """The stretches of each text.

    A text is cut wherever a sentence may end, so every sentence is made of whole pieces. If no language gains CHANGE / 2
    or more over the text's best one on the pieces it explains better, no path with a change can pay for its changes, and
    the text is in one language without its sentences being known. Only the others are cut into sentences.
    """
    found = [(_ASCII_SCAN if t.isascii() else _SCAN).findall(t) for t in texts]
    n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    codes = m.coded(list(itertools.chain.from_iterable(found)))
    of = np.repeat(np.arange(len(texts)), n)
    word = codes >= 0
    # pieces are numbered through all texts: a new one begins behind each possible end and with each text
    piece = (np.cumsum(codes == _END) + of)[word]
    out: list = [None] * len(texts)
    if len(piece):
        rows, of = codes[word], of[word]
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        scores = np.add.reduceat(m.table[rows], starts, axis=0, dtype=np.float64)
        firsts = np.flatnonzero(np.diff(of[starts], prepend=-1))  # the first piece of each text that has one
        docs = of[starts][firsts]
        words = np.bincount(of, minlength=len(texts))[docs]
        letters = np.bincount(of, weights=m.letters[rows], minlength=len(texts)).astype(np.int64)[docs]
        whole = np.add.reduceat(scores, firsts, axis=0)
        top = whole.argmax(axis=1)
        own = scores[np.arange(len(scores)), np.repeat(top, np.diff(np.append(firsts, len(starts))))]
        gains = np.add.reduceat(np.maximum(scores - own[:, None], 0.0), firsts, axis=0).max(axis=1)
        for k, row, size, count, code, gain in zip(docs.tolist(), whole, letters.tolist(), words.tolist(), top.tolist(), gains.tolist()):
            if size < FEWEST:
                continue
            if gain < CHANGE / 2:
                out[k] = [(0, len(texts[k].rstrip()), *m.named(row, size + count, code))]
            else:
                spans, found_words = _units(texts[k], st)
                out[k] = stretches(spans, found_words, *m.scores(found_words), m)
    return [[(0, len(t.rstrip()), "und", 1.0)] if got is None else got for t, got in zip(texts, out)]


def train(sample: list[tuple[int, str, list[str]]]) -> Models:
    """Models from (document, language, words of a sentence) rows.

    Each half of the sample is cleaned by models trained on the other half: a sentence that another language explains
    better is dropped, with its document where most are, so documents with a wrong label don't teach their words to that label's model.
    """
    units = [u for u in sample if u[2]]

    def seeded() -> dict[str, Counter]:
        return {c: Counter(s.split() * 2) for c, s in SEEDS.items()}

    kept = []
    for half in (0, 1):
        counts = seeded()
        for k, code, w in units:
            if k % 2 != half:
                counts[code].update(w)
        judge = Models(counts)
        own = [u for u in units if u[0] % 2 == half]
        top = judge.scores([w for _, _, w in own])[0].argmax(axis=1) if own else []
        own = [(k, code, w, judge.codes[t] == code) for (k, code, w), t in zip(own, top)]
        right, every = Counter(k for k, _, _, ok in own if ok), Counter(k for k, *_ in own)
        kept += [(k, code, w) for k, code, w, ok in own if ok and 2 * right[k] >= every[k]]
    counts = seeded()
    # whole documents are kept back for the calibration, every tenth
    number = {k: i for i, k in enumerate(dict.fromkeys(k for k, _, _ in kept))}
    for k, code, w in kept:
        if number[k] % 10:
            counts[code].update(w)
    m = Models(counts)
    back = [u for u in kept if number[u[0]] % 10 == 0]
    if back:
        at = {c: i for i, c in enumerate(m.codes)}
        scores, sizes = m.scores([w for _, _, w in back])
        own = np.array([at[c] for _, c, _ in back])
        mine = scores[np.arange(len(back)), own]

        def loss(t: float) -> float:
            return float(np.mean(np.log(np.exp(np.clip((scores - mine[:, None]) * t, -60, 60)).sum(axis=1))))

        m.temperature = min((0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0), key=loss)
        m.calibrate([(k, c, float(s), int(n)) for (k, c, _), s, n in zip(back, mine, sizes)])
    m.forget()
    return m


def _spaced(items: list, most: int) -> list:
    """At most `most` evenly spaced items."""
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


def sample_of(documents: DataFrame, known, size: int = SAMPLE) -> list[tuple[int, str, list[str]]]:
    """(document, language, words of a sentence) of about `size` labelled documents a language, drawn by the hash of their id; known: the broadcast page matter and statistics."""
    names = sorted(n for n, c in _CODES.items() if c != "und")
    label = F.lower(F.trim(F.col("lang")))
    head = F.split(label, "[-_ ]")[0]
    code = F.create_map(*[F.lit(x) for n in names for x in (n, _CODES[n])])
    named = documents.select("doc_id", "text", "report", F.coalesce(code[label], code[head]).alias("code")).where("code is not null")
    n = {r[0]: r[1] for r in named.groupBy("code").count().collect()}  # a row a language
    if not n:
        return []
    share = F.create_map(*[F.lit(x) for c, k in n.items() for x in (c, min(1.0, size / k))])
    drawn = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < share[F.col("code")]).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matter, st = known.value
        for b in batches:
            ids, codes, held = [], [], []
            for doc, lang, text, report in zip(*(b.column(c).to_pylist() for c in ("doc_id", "code", "text", "report"))):
                for words in _spaced([w for w in _units(without_page_matter(text, report, matter), st)[1] if w], SENTENCES):
                    ids.append(doc)
                    codes.append(lang)
                    held.append(_spaced([p for w in _spaced(words, WORDS) for p in (w[i:i + LETTERS] for i in range(0, len(w), LETTERS))], 4 * WORDS))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.string()), pa.array(held, pa.list_(pa.string()))], ["doc", "code", "words"])

    rows = drawn.mapInArrow(run, "doc long, code string, words array<string>").collect()  # the bounded sample
    number = {d: k for k, d in enumerate(sorted({r[0] for r in rows}))}
    return sorted(((number[r[0]], r[1], r[2]) for r in rows), key=lambda r: (r[0], r[1]))


def language_stretches(documents: DataFrame) -> DataFrame:
    """doc_id, char_start, char_end, lang, confidence of every stretch; label: the language that the document's label names."""
    context = documents.sparkSession.sparkContext
    scanned = documents.where(F.col("text").contains("\f")).select("report", F.explode(F.split("text", "\f")).alias("text"))
    known = context.broadcast((learn_matter(scanned, keys=False)[0], S.corpus_statistics(documents)))
    sent = context.broadcast(train(sample_of(documents, known)))  # of the sample's size

    def judged(docs: list[tuple[int, str | None, str]], m: Models, st: S.Statistics) -> pa.RecordBatch:
        rows = []
        for (doc, lang, _), got in zip(docs, judge([t for _, _, t in docs], m, st)):
            label = label_code(lang)
            rows += [(doc, a, b, c, p, len(got), label) for a, b, c, p in got]
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.string())],
            ["doc_id", "char_start", "char_end", "lang", "confidence", "stretches", "label"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (matter, st) = sent.value, known.value
        for batch in batches:
            docs, n = [], 0
            for doc, lang, text, report in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text", "report"))):
                if text and text.strip():
                    docs.append((doc, lang, without_page_matter(text, report, matter)))
                    n += len(text)
                if n > 2_000_000:  # characters judged together
                    yield judged(docs, m, st)
                    docs, n = [], 0
            yield judged(docs, m, st)

    schema = "doc_id long, char_start int, char_end int, lang string, confidence double, stretches int, label string"
    return documents.select("doc_id", "text", "lang", "report").mapInArrow(run, schema)


def wrong_labels(documents: DataFrame) -> DataFrame:
    """doc_id, char_start, lang: documents whose label is missing or wrong, and all stretches of documents in several languages."""
    s = language_stretches(documents)
    return s.where((F.col("stretches") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("doc_id", "char_start", "lang").distinct()
