"""Term mining: enumeration, exclusion, document and term frequency, evidence, observations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions import text
from saltmarsh.functions.text import camel_sequence, plain_sequence, salt_sequence, signal_kind
from saltmarsh.session import cut

#: Stands between the tokens of a run; no token holds it.
GLUE = "\u001f"


_WORD = re.compile(text.WORD, re.ASCII)
_STOP = frozenset(text.STOPWORDS)
#: Terms a task counts before it hands them on.
MOST_HELD = 500_000


def grams_of(t: str | None, longest: int = 3) -> list[str]:
    """All runs of 1 to `longest` neighbouring words of a text, with repetitions; the worker's form of functions.text.ngrams."""
    words = [w for x in _WORD.findall(t or "") if len(x) >= 3 and (w := x.lower()) not in _STOP]
    out = list(words)
    for n in range(2, longest + 1):
        out += map(" ".join, zip(*(words[k:] for k in range(n))))
    return out


def term_counts(documents: DataFrame, key: str = "doc_id", longest: int = 3, terms: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """key, term, occurrences of every n-gram, or of the given terms only (term); one row a term leaves each text.

    With terms, the join comes before the aggregation; Spark broadcasts the terms if they are small enough. With unique,
    every key has one row, and nothing is aggregated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, grams, n = [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                c = Counter(grams_of(t, longest))
                at += [k] * len(c)
                grams += c.keys()
                n += c.values()
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(grams, pa.string()), pa.array(n, pa.int64())], [key, "term", "occurrences"])

    rows = documents.select(key, "text")
    each = rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("term", T.StringType()), T.StructField("occurrences", T.LongType())]))
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.select(key, "term", "occurrences") if unique else each.groupBy(key, "term").agg(F.sum("occurrences").alias("occurrences"))


def frequencies(documents: DataFrame, longest: int = 3) -> DataFrame:
    """term, doc_frequency, total_occurrences of all n-grams; documents are rows of one key each.

    Each task counts its own texts, so one row a term and task is shuffled, however frequent the term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, tf = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(tf), pa.string()), pa.array([df[t] for t in tf], pa.int64()), pa.array(list(tf.values()), pa.int64())], ["term", "d", "n"])
            df.clear()
            tf.clear()
            return got

        for b in batches:
            for t in b.column("text").to_pylist():
                grams = grams_of(t, longest)
                tf.update(grams)
                df.update(set(grams))
                if len(tf) > MOST_HELD:
                    yield flush()
        yield flush()

    each = documents.select("text").mapInArrow(run, "term string, d long, n long")
    return each.groupBy("term").agg(F.sum("d").alias("doc_frequency"), F.sum("n").alias("total_occurrences"))


def document_frequency(documents: DataFrame, longest: int = 3, terms: DataFrame | None = None) -> DataFrame:
    """term, doc_frequency of all n-grams, or of the given terms (term), of which one that no document holds has 0."""
    got = frequencies(documents, longest).select("term", "doc_frequency")
    if terms is None:
        return got
    return terms.select("term").distinct().join(got, "term", "left").select("term", F.coalesce("doc_frequency", F.lit(0)).alias("doc_frequency"))


def observed_frequency(each: DataFrame) -> DataFrame:
    """term, doc_frequency derived from observations (term, document): documents that name a term, each once."""
    return each.where("document is not null").select("term", "document").distinct().groupBy("term").agg(F.count("*").alias("doc_frequency"))


def representative_surfaces(surfaces: DataFrame) -> DataFrame:
    """term, surface_form: of the surfaces (term, surface_form) of a term the shortest, of equally long ones the first in order."""
    best = F.min(F.struct(F.length("surface_form").alias("n"), F.col("surface_form").alias("s"))).alias("b")
    return surfaces.where("surface_form is not null").groupBy("term").agg(best).select("term", F.col("b.s").alias("surface_form"))


def runs(sequence) -> F.Column:
    """All neighbouring runs of an array of tokens, glued; duplicates once."""
    n = F.size(sequence)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(sequence, i, k), GLUE)))))


def exclusion_keys(labels: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """run: glued token sequences of known labels (label, kind) and of surfaces of linked mentions (surface_form)."""
    seq = F.when(F.col("kind") == "salt", salt_sequence(F.col("label"))).otherwise(camel_sequence(F.col("label")))
    keys = labels.select(F.array_join(seq, GLUE).alias("run"))
    if surfaces is not None:
        keys = keys.unionByName(surfaces.select(F.array_join(plain_sequence(F.col("surface_form")), GLUE).alias("run")))
    return keys.where("run <> ''").distinct()


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_APART = re.compile(r"[^A-Za-z0-9]+")


def runs_of(term: str | None) -> set[str]:
    """All neighbouring runs of the tokens of a term, glued; the worker's form of `runs` over camel_sequence."""
    words = [t for t in _APART.split((term if not term or term.islower() else _CAMEL.sub(" ", term)).lower()) if t] if term else []
    return {GLUE.join(words[i:k]) for i in range(len(words)) for k in range(i + 1, len(words) + 1)}


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, found = [], []
        for k, term in enumerate(b.column("term").to_pylist()):
            own = runs_of(term)
            at += [k] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([b.column("term").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["term", "run"])


def excluded(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """candidates (term) that hold no known sequence whole: an anti-join on exploded runs."""
    hit = candidates.select("term").mapInArrow(_run_rows, "term string, run string").join(keys, "run", "left_semi").select("term").distinct()
    return candidates.join(hit, "term", "left_anti")


def evidence(segments: DataFrame, terms: DataFrame | None = None, longest: int = 3) -> DataFrame:
    """term, report, start_offset, end_offset, sentence_text: each place (report and beginning) that holds a term, once.

    Places stay rows: a term may have any number of them, so they are never gathered into an array.
    """
    rows = segments.select(F.struct("report", F.col("char_start").alias("start_offset"), F.col("char_end").alias("end_offset"), F.col("text").alias("sentence_text")).alias("place"), "text")
    each = term_counts(rows, "place", longest, terms, unique=True).select("term", "place.*")
    first = F.min(F.struct("end_offset", "sentence_text")).alias("f")  # of places with one beginning the shortest
    return each.groupBy("term", "report", "start_offset").agg(first).select("term", "report", "start_offset", "f.end_offset", "f.sentence_text")


def misses(mentions: DataFrame) -> DataFrame:
    """term, surface_form, report, start_offset, end_offset, sentence_text of spans that name nothing known (status `novel`); blank ones are none."""
    novel = mentions.where("status = 'novel' and surface_form is not null").where(F.trim("surface_form") != "")
    return novel.select(F.lower("surface_form").alias("term"), "surface_form", "report", F.col("char_start").alias("start_offset"), F.col("char_end").alias("end_offset"), F.col("surface_form").alias("sentence_text")).distinct()


def with_first_evidence(each: DataFrame, *keys: str) -> DataFrame:
    """term (and keys), report, start_offset, end_offset, sentence_text of the first place of each term, and the number of places."""
    first = F.min(F.struct("report", "start_offset", "end_offset", "sentence_text")).alias("f")
    return each.groupBy("term", *keys).agg(first, F.count("*").alias("places")).select("term", *keys, "places", "f.*")


def mine(documents: DataFrame, known: DataFrame | None = None, floor: int = 50, ceiling: int | None = 5000, longest: int = 3) -> DataFrame:
    """term, doc_frequency, total_occurrences of the candidates: n-grams, without known ones, not below the floor, the most frequent `ceiling`.

    The ceiling is a report's top-k; ties go by term. What passes the floor is checkpointed, as the exclusion reads it twice.
    """
    f = frequencies(documents, longest).where(F.col("doc_frequency") >= floor)
    if known is not None:
        f = excluded(cut(f), known)
    return f if ceiling is None else f.orderBy(F.desc("doc_frequency"), "term").limit(ceiling)


def _counts(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts).agg(*[F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in frames])


class Mined(NamedTuple):
    """What mining gives: candidates sorted by term, their places and observations as rows, and the counters of the run."""

    candidates: DataFrame
    evidence: DataFrame
    observations: DataFrame
    counters: DataFrame


def mine_all(segments: DataFrame, mentions: DataFrame, documents: DataFrame, known: DataFrame, floor: int = 50, ceiling: int = 5000, corpus: str = "corpus", longest: int = 3) -> Mined:
    """Terms of segments (lexical) and surfaces that name nothing known (miss), without known ones, not below the floor, the most frequent `ceiling`.

    Document frequency is that of the observations, so both agree. The ceiling is a guard of what follows, a top-k with
    ties by term; what it cuts is counted.
    """
    lexical = frequencies(segments, longest).select("term", F.lit("lexical").alias("source"), F.lit("").alias("surface_form"))
    missed = misses(mentions)
    every = cut(lexical.unionByName(representative_surfaces(missed).select("term", F.lit("miss").alias("source"), "surface_form")))
    kept = cut(excluded(every, known))
    scored = kept.join(frequencies(documents, longest), "term", "inner" if floor > 0 else "left").na.fill(0, ["doc_frequency", "total_occurrences"])
    scored = cut(scored.where(F.col("doc_frequency") >= floor))
    top = cut(scored.orderBy(F.desc("doc_frequency"), "term", "source").limit(ceiling))
    places = evidence(segments, top.where("source = 'lexical'"), longest).withColumn("source", F.lit("lexical"))
    places = places.unionByName(missed.join(top.where("source = 'miss'").select("term"), "term", "left_semi").drop("surface_form").withColumn("source", F.lit("miss")))
    seen = observations(documents, top, corpus, longest)
    first = with_first_evidence(places, "source")
    found = top.drop("doc_frequency").join(observed_frequency(seen), "term", "left").na.fill(0, ["doc_frequency"]).join(first, ["term", "source"], "left").orderBy("term", "source")
    counters = _counts(enumerated=every, kept=kept, scored=scored, retained=top).select("enumerated", (F.col("enumerated") - F.col("kept")).alias("excluded"), (F.col("kept") - F.col("scored")).alias("below_floor"), (F.col("scored") - F.col("retained")).alias("cut_by_ceiling"), "retained")
    return Mined(found, places, seen, counters)


def observations(documents: DataFrame, terms: DataFrame, corpus: str = "corpus", longest: int = 3) -> DataFrame:
    """term, document, corpus, occurrence_count of every document that holds a term: also the back-fill of staged proposals."""
    counts = term_counts(documents, longest=longest, terms=terms)
    return counts.join(documents.select("doc_id", F.col(corpus).alias("corpus")), "doc_id").select("term", F.col("doc_id").alias("document"), "corpus", F.col("occurrences").alias("occurrence_count"))


def triaged(candidates: DataFrame) -> DataFrame:
    """candidates (term, source, sentences) with the kind their sentences suggest, and where it goes.

    An instance is accepted or dropped, a class rides with its instances, a property or relation becomes a proposal;
    without a kind it waits for a classifier.
    """
    kind = signal_kind(F.array_join("sentences", " "), F.col("source"))
    route = F.when(F.col("kind") == "instance", "accept").when(F.col("kind") == "class", "with-instance").when(F.col("kind").isin("property", "relation"), "proposal").otherwise("classifier")
    return candidates.withColumn("kind", kind).withColumn("route", route)


def mine_summary(outcomes: DataFrame) -> DataFrame:
    """One row: candidates, proposals_by_kind and the counters of a mining run, from one row a candidate (kind, outcome).

    outcome is one of `proposal`, `auto_accepted`, `rejected`, `triage_rejected`, `dropped_malformed`, `dropped`.
    """
    counter = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    kinds = ("property", "instance", "class", "relation")
    by_kind = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.count_if((F.col("outcome") == "proposal") & (F.col("kind") == k)).alias("n")) for k in kinds]), lambda x: x["n"] > 0))
    rest = ["auto_accepted", "rejected", "triage_rejected", "dropped_malformed", "dropped"]
    return outcomes.agg(F.count("*").alias("candidates"), by_kind.alias("proposals_by_kind"), *map(counter, rest))


def backfill_summary(proposals: DataFrame, observed: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: proposals_processed, observations_written, documents_tagged, scalars_removed.

    observed: term, document, corpus; stale: the scalar counts that the observations replace.
    """
    seen = observed.where("document is not null").select("term", "document", "corpus").distinct()
    tagged = seen.select("corpus", "document").distinct()
    return _counts(proposals_processed=proposals, observations_written=seen, documents_tagged=tagged, scalars_removed=stale)
