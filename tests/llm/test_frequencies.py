import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from saltmarsh.llm.frequencies import SuffixArray, _collapsed, _merged, longest_term, ngram_frequencies, same_term, term_frequencies


@pytest.mark.parametrize("a, b", [(" Drain  Tank", "drain tank"), ("Off‑gas", "off-gas"), ("Off–GAS", "off-gas"), ("Rück", "rück"), ("É", "é"), ("a\t\nb", "a b")])
def test_spellings(a, b):
    assert same_term(a) == same_term(b)


def counted(texts, longest=None):
    tf, df = Counter(), Counter()
    for t in texts:
        grams = [tuple(t[i:i + k]) for k in range(1, min(len(t), longest or len(t)) + 1) for i in range(len(t) - k + 1)]
        tf.update(grams)
        df.update(set(grams))
    return {g: (tf[g], df[g]) for g in tf}


@pytest.mark.parametrize("longest", [None, 3])
@pytest.mark.parametrize("seed", range(5))
def test_intervals_of_all_lengths_against_counting(seed, longest):
    r = random.Random(seed)
    texts = [[r.randint(1, 3) for _ in range(r.randint(0, 14))] for _ in range(30)]
    texts += [list(t) for t in texts[:5]]  # copies
    codes = np.array([c for t in texts for c in t])
    array = SuffixArray(codes, np.array([len(t) for t in texts]), longest=longest)
    got = {tuple(codes[i:i + n].tolist()): (int(a), int(b)) for n, first, occ, rec in array.intervals(longest) for i, a, b in zip(first, occ, rec)}
    assert got == counted(texts, longest)


def test_the_array_is_sorted():
    codes = np.array([3, 1, 2, 3, 1, 2, 2, 1])
    array = SuffixArray(codes, np.array([5, 3]))
    ends = [5] * 5 + [8] * 3
    suffixes = [codes[i:ends[i]].tolist() for i in array.order]
    assert suffixes == sorted(suffixes)
    assert array.common.tolist() == [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:])]


def test_a_term_twice_in_one_record():
    """Repetitions are subtracted within the array of a block and again where blocks meet; nothing is made distinct before."""
    rows = list(zip(["fuel salt", "salt", "fuel salt", "fuel salt", "salt", "fuel salt"], ["d1", "d1", "d2", "d1", "d1", "d3"], [2, 1, 5, 4, 1, 0]))
    block = _collapsed(*map(list, zip(*rows)))
    assert sorted(zip(*(c.to_pylist() for c in block.columns))) == [("fuel salt", "d1", 4), ("fuel salt", "d2", 5), ("fuel salt", "d3", 0), ("salt", "d1", 1)]
    twice = sorted(list(zip(*(c.to_pylist() for c in block.columns))) + [("fuel salt", "d1", 3), ("salt", "d9", 7)])
    cut = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["term", "record", "weight"]) for part in (twice[:2], twice[2:])]
    got = {t: (o, n) for b in _merged(iter(cut)) for t, o, n in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {"fuel salt": (9, 3), "salt": (8, 2)}


OBS = "array<struct<document_iri: string, corpus: string, occurrence_count: int>>"


def test_terms(spark):
    rows = [
        ("Drain Tank", [("d1", "c", 2), ("d2", "c", 3), (None, "c", 9)], 1), (" drain tank ", [("d1", "x", 2)], 1), ("drain tank", None, 1), ("lonely", [], 1), ("", [("d1", "c", 1)], 1), (None, [("d1", "c", 1)], 1),
        ("nul", [("d3", None, None)], 1), ("nul", [("d3", None, None)], 1),
    ]
    got = {r.term: (r.document_frequency, r.total_occurrences, r.mark) for r in term_frequencies(spark.createDataFrame(rows, f"term string, observations {OBS}, mark int")).collect()}
    assert got == {"drain tank": (2, 5, "rare"), "nul": (1, 0, "rare")}
    assert term_frequencies(spark.createDataFrame([], f"term string, observations {OBS}")).count() == 0


def test_marks(spark):
    rows = [("common", [(f"d{i}", "c", 1) for i in range(10)]), ("useful", [(f"d{i}", "c", 1) for i in range(3)]), *[("x", [(f"d{i}", "c", 1)]) for i in range(99)]]
    got = {r.term: r.mark for r in term_frequencies(spark.createDataFrame(rows, f"term string, observations {OBS}")).collect()}
    assert got == {"common": "common", "useful": "useful", "x": "common"}


def test_ngrams(spark):
    d = spark.createDataFrame([(1, "a b a b"), (2, "B a"), (3, None), (4, "")], "doc_id int, text string")
    got = {r.ngram: (r.occurrences, r.records) for r in ngram_frequencies(d, 2).collect()}
    assert got == {"a": (3, 2), "b": (3, 2), "a b": (2, 1), "b a": (2, 2)}
    whole = {r.ngram: (r.occurrences, r.records) for r in ngram_frequencies(d).collect()}
    assert whole == got | {"a b a": (1, 1), "b a b": (1, 1), "a b a b": (1, 1)}
    assert longest_term(spark.createDataFrame([("a", ), ("fuel-salt drain tank", ), (None, )], "term string")) == 4
