"""Problem 6: how often every term occurs in the collection and in how many records.

The core is a suffix array with common-prefix intervals. Words are numbered, records are strung together with separators
of their own, and the array is sorted by prefix doubling, whose ranks also give the common prefix of neighbours. An
n-gram is an interval of neighbours with at least n words in common; its weighted width is the number of occurrences.
For the number of records, each suffix is paired with the one before it of the same record: the least common prefix
between the two says up to which n the suffix only repeats its record, and each such adjacency is subtracted.

Terms: an observation is the sequence of its term's words between marks for the beginning and the end, so a whole term is
an interval too. Each task sorts blocks of observations and hands on one row for each interval and record; these rows
are sorted over all blocks by term and record (a sort that spills), which merges the arrays, and repetitions of a record
in different blocks are subtracted in the same way, neighbour by neighbour. Hot terms are spread by their records and
records by their terms; only numbers are added at the end.

Defined results: a null document, a null or empty list of observations and a blank term give no row; an occurrence
count that is null counts 0; a term and document count once, with the largest count where they differ; an empty table
gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term in fewer records is rare; one in more than this share of all records is common.
RARE_BELOW, COMMON_ABOVE = 3, 0.05
#: Kinds of hyphen that count as `-` (fixed values).
HYPHENS = "‐‑‒–—―⁃−﹘﹣－"
_TO_HYPHEN = {ord(c): "-" for c in HYPHENS} | {0xAD: None, 0x200B: None, 0xFEFF: None}


def same_term(term: str | None) -> str:
    """The form that all spellings of a term share: NFC, lower case, single spaces, `-` for every hyphen."""
    if not term:
        return ""
    t = term if term.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFC", term).translate(_TO_HYPHEN).lower())
    return " ".join(t.lower().split())


class SuffixArray:
    """The suffixes of records in order, with the common prefix of neighbours.

    codes: numbers (at least 1) of the words of all records, one record after the other; size: words of each record;
    tie: a number for each record by which equal suffixes are ordered. With longest, suffixes are only told apart by so
    many words, and a common prefix of more counts as any number from longest on.
    """

    def __init__(self, codes: np.ndarray, size: np.ndarray, tie: np.ndarray | None = None, longest: int | None = None) -> None:
        records = len(size)
        self.record = np.repeat(np.arange(records), size)
        ends = np.cumsum(size)
        self.left = np.repeat(ends, size) - np.arange(len(codes))  # words to the end of the record
        # separators, each of its own, stand before all words
        order = np.arange(records) if tie is None else np.lexsort((np.arange(records), tie))
        mark = np.empty(records, dtype=np.int64)
        mark[order] = np.arange(records)
        text = np.insert(codes.astype(np.int64) + records, ends, mark)
        where = np.arange(len(codes)) + self.record
        levels = [np.unique(text, return_inverse=True)[1]]
        n, step = len(text), 1
        while len(levels[-1]) and levels[-1].max() + 1 < n and (longest is None or step < longest):
            rank = levels[-1]
            second = np.zeros(n, dtype=np.int64)
            second[:-step] = rank[step:] + 1
            levels.append(np.unique(rank * (n + 1) + second, return_inverse=True)[1])
            step *= 2
        by_rank = np.argsort(levels[-1][where], kind="stable")
        self.order = by_rank  # suffixes in order, as places in codes
        at = where[by_rank]
        a, b = at[:-1], at[1:]
        common = np.zeros(max(0, len(at) - 1), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):  # the longest power of two first
            x, y = a + common, b + common
            same = (x < n) & (y < n)
            same[same] = levels[k][x[same]] == levels[k][y[same]]
            common += same << k
        self.common = common

    def repeats(self) -> np.ndarray:
        """For each place in the array, up to how many words its suffix repeats an earlier one of its record."""
        n = len(self.order)
        out = np.zeros(n, dtype=np.int64)
        if n < 2:
            return out
        by_record = np.lexsort((np.arange(n), self.record[self.order]))
        prev, cur = by_record[:-1], by_record[1:]
        own = self.record[self.order[prev]] == self.record[self.order[cur]]
        prev, cur = prev[own], cur[own]
        # least common prefix between two places: minima of blocks of powers of two
        table = [self.common]
        while 2 << (len(table) - 1) <= n - 1:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        span = cur - prev
        level = np.frexp(span.astype(np.float64))[1] - 1
        for k in range(len(table)):
            at = level == k
            if at.any():
                t = table[k]
                out[cur[at]] = np.minimum(t[prev[at]], t[cur[at] - (1 << k)])
        return out

    def intervals(self, longest: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1, 2, ...: (n, the place of one suffix of each n-gram, occurrences, records)."""
        repeats, left = self.repeats(), self.left[self.order]
        top = int(left.max(initial=0))
        for n in range(1, min(top, longest or top) + 1):
            starts = np.flatnonzero(np.concatenate(([True], self.common < n)))
            keep = left[starts] >= n
            width = np.diff(np.append(starts, len(self.order)))
            again = np.add.reduceat((repeats >= n).astype(np.int64), starts)
            yield n, self.order[starts[keep]], width[keep], (width - again)[keep]


#: Observations of one suffix array.
BLOCK = 200_000
_BEGIN, _END = 1, 2


def _collapsed(terms: list[str], records: list[str], weights: list[int]) -> pa.RecordBatch:
    """One row for each whole term and record of a block of observations, with the largest weight."""
    words = [t.split(" ") for t in terms]
    number: dict[str, int] = {}
    codes, size = [], np.array([len(w) + 2 for w in words])
    for w in words:
        codes.append(_BEGIN)
        codes += [number.setdefault(x, len(number) + 3) for x in w]
        codes.append(_END)
    docs = pa.array(records).dictionary_encode()
    doc, weight = np.asarray(docs.indices).astype(np.int64), np.asarray(weights, dtype=np.int64)
    tie = np.empty(len(doc), dtype=np.int64)
    tie[np.lexsort((weight, doc))] = np.arange(len(doc))  # equal terms lie by record, the largest weight last
    array = SuffixArray(np.array(codes, dtype=np.int64), size, tie)
    whole = np.flatnonzero(array.left[array.order] == size[array.record[array.order]])  # suffixes that begin with the mark: one stretch of the array
    obs = array.record[array.order[whole]]
    common = array.common[whole[:-1]] if len(whole) > 1 else np.zeros(0, dtype=np.int64)
    # the interval of a whole term goes on where all words and both marks agree; within it, a record followed by itself is a repetition
    again = (common >= size[obs[:-1]]) & (doc[obs[1:]] == doc[obs[:-1]])
    last = obs[np.append(~again, True)]
    return pa.RecordBatch.from_arrays([pa.array([terms[k] for k in last], pa.string()), docs.dictionary.take(pa.array(doc[last])), pa.array(weight[last], pa.int64())], ["term", "record", "weight"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole terms and records of blocks of observations."""
    terms, records, weights = [], [], []
    form: dict[str, str] = {}
    for b in batches:
        for term, record, weight in zip(*(b.column(c).to_pylist() for c in ("term", "record", "weight"))):
            t = form.get(term)
            if t is None:
                if len(form) > BLOCK:
                    form.clear()
                t = form[term] = same_term(term)
            if t:
                terms.append(t)
                records.append(record)
                weights.append(weight)
        if len(terms) >= BLOCK:
            yield _collapsed(terms, records, weights)
            terms, records, weights = [], [], []
    if terms:
        yield _collapsed(terms, records, weights)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and records of each term from rows sorted by term, record and weight: neighbours of one record are repetitions."""
    names = ["term", "occurrences", "records"]
    term, record, weight, occurrences, n = None, None, 0, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        t, r = b.column("term").to_pylist(), b.column("record").to_pylist()
        out: list[tuple[str, int, int]] = []
        for x, y, w in zip(t, r, b.column("weight").to_pylist()):
            if x != term:
                if term is not None:
                    out.append((term, occurrences, n))
                term, occurrences, n = x, w, 1
            elif y == record:
                occurrences += w - weight
            else:
                occurrences, n = occurrences + w, n + 1
            record, weight = y, w
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names)
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([term], pa.string()), pa.array([occurrences], pa.int64()), pa.array([n], pa.int64())], names)


def term_frequencies(candidates: DataFrame) -> DataFrame:
    """term, document_frequency, total_occurrences, mark of every term with an observation that names a document."""
    observed = (
        candidates.where("term is not null").select("term", F.explode("observations").alias("o")).where("o.document_iri is not null")
        .select("term", F.col("o.document_iri").alias("record"), F.coalesce(F.col("o.occurrence_count"), F.lit(0)).cast("long").alias("weight"))
    )
    rows = observed.mapInArrow(_blocks, "term string, record string, weight long")
    rows = rows.repartition("term", "record").sortWithinPartitions("term", "record", "weight")
    counted = rows.mapInArrow(_merged, "term string, occurrences long, records long").groupBy("term").agg(F.sum("records").alias("document_frequency"), F.sum("occurrences").alias("total_occurrences"))
    named = candidates.select(F.explode("observations.document_iri").alias("d")).agg(F.count_distinct("d")).first()[0]  # one number
    df = F.col("document_frequency")
    mark = F.when(df < RARE_BELOW, "rare").when(df > F.lit(COMMON_ABOVE) * F.lit(named), "common").otherwise("useful")
    return counted.select("term", "document_frequency", "total_occurrences", mark.alias("mark"))


#: A word: letters, figures and their marks.
WORDS = regex.compile(r"[\p{L}\p{N}\p{M}_]+")


#: Words of one suffix array of texts.
WORDS_A_BLOCK = 1_000_000


def _ngrams(longest: int | None):
    def block(split: list[list[str]]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        codes = np.array([number.setdefault(w, len(number) + 1) for ws in split for w in ws], dtype=np.int64)
        names = np.array(["", *number], dtype=object)
        array = SuffixArray(codes, np.array([len(ws) for ws in split]), longest=longest)
        for n, first, occurrences, records in array.intervals(longest):
            grams = names[codes[first]]
            for k in range(1, n):
                grams = grams + " " + names[codes[first + k]]
            yield pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), pa.array(np.full(len(first), n), pa.int32()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], ["ngram", "n", "occurrences", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                if text and (ws := WORDS.findall(text.lower())):
                    held.append(ws)
                    n += len(ws)
                    if n >= WORDS_A_BLOCK:
                        yield from block(held)
                        held, n = [], 0
        if held:
            yield from block(held)

    return run


def longest_term(candidates: DataFrame) -> int:
    """Words of the longest term, 1 at least."""
    count = F.pandas_udf(lambda s: pd.Series([len(WORDS.findall(t.lower())) if isinstance(t, str) else 0 for t in s]), "int")
    return candidates.agg(F.max(count("term"))).first()[0] or 1  # one number


def ngram_frequencies(documents: DataFrame, longest: int | None = None) -> DataFrame:
    """ngram, n, occurrences, records, mark of the word n-grams of the texts up to `longest` words, of all lengths where it is None.

    Each task makes suffix arrays of whole records, so their counts are exact partial sums that are added.
    """
    partial = documents.select("text").mapInArrow(_ngrams(longest), "ngram string, n int, occurrences long, records long")
    counted = partial.groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    total = documents.count()
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") > F.lit(COMMON_ABOVE) * F.lit(total), "common").otherwise("useful")
    return counted.withColumn("mark", mark)
