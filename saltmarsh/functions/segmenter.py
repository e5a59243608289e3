"""Sentences of a report with absolute offsets: paragraphs at empty lines, then rules for full stops.

Row-local, so an Arrow UDF over documents without a shuffle. It is meant for reports in English; the text operators
hold a splitter for many languages and scripts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset("approx dr prof mr mrs ms st no nos fig figs eq eqs sec vol ref refs pp p cf vs et al e.g i.e etc ca dept inc ltd jr wt max min ed eds".split())
_STOP = re.compile(r"[.!?]+[\"')\]]*(?=\s+[\"'(\[]*[A-Z0-9])")
_TOKEN = re.compile(r"([\w.]+)\Z")


def spans(text: str | None) -> list[tuple[int, int]]:
    """Half-open offsets: text[start:end] is a sentence without blanks around it."""
    out: list[tuple[int, int]] = []
    for para in re.finditer(r"\S(?:.|\n(?!\s*\n))*", text or ""):
        start, end = para.start(), para.start() + len(para[0].rstrip())
        for m in _STOP.finditer(text, start, end):
            word = _TOKEN.search(text, max(start, m.start() - 20), m.start())
            token = (word[1] if word else "").lower()
            initial = len(token) == 1 and token.isalpha() and not re.search(r"\d\s*\Z", text[max(start, m.start() - 8):m.start() - 1])  # a letter behind a number is a unit
            if text[m.start()] == "." and (token in ABBREVIATIONS or initial or "." in token and not token[-1].isdigit()):
                continue
            out.append((start, m.end()))
            start = re.compile(r"\s*").match(text, m.end()).end()
        if start < end:
            out.append((start, end))
    return out


def segments(documents: DataFrame, key: str = "report") -> DataFrame:
    """key, seg_index, text, char_start, char_end; null and blank texts give no row."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, t[x:y], x, y) for i, t in enumerate(b.column("text").to_pylist()) for n, (x, y) in enumerate(spans(t))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.string(), pa.int32(), pa.int32())))], [key, "seg_index", "text", "char_start", "char_end"])

    return documents.select(key, "text").mapInArrow(run, f"{key} {kind}, seg_index int, text string, char_start int, char_end int")
