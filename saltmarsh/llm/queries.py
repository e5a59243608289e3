"""Queries of the text operators, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm import frequencies, languages, linking, packing, scans, sentences, tokens
from saltmarsh.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences.split_documents(table(spark, base, "documents"), table(spark, base, "segments"))


@query()
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return linking.link_novel(table(spark, base, "mentions"), table(spark, base, "concepts"), table(spark, base, "ornl_tm_2316_gold"))


@query()
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return scans.repair_scans(table(spark, base, "segments"), table(spark, base, "evidence"))


@query()
def p5_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    return scans.repaired_pages(table(spark, base, "segments"), table(spark, base, "evidence"))


@query(r"""
with seen as (
  select trim(regexp_replace(lower(regexp_replace(nfc_normalize(c.term), '[‐‑‒–—―⁃−﹘﹣－]', '-', 'g')), '[\s\x{00a0}]+', ' ', 'g')) as term,
         o.document_iri as doc, max(coalesce(o.occurrence_count, 0)) as n
  from (select term, unnest(observations) as o from candidates) c
  where o.document_iri is not null and c.term is not null
  group by 1, 2
), total as (select count(distinct doc) as n from seen)
select term, count(*) as document_frequency, cast(sum(n) as bigint) as total_occurrences,
       case when count(*) < 3 then 'rare' when count(*) > 0.05 * (select n from total) then 'common' else 'useful' end as mark
from seen where term <> '' group by term
""")
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return frequencies.term_frequencies(table(spark, base, "candidates"))


@query(r"""
with words as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') as w from documents where text is not null
), grams as (
  select doc_id, k as n, array_to_string(w[i:i + k - 1], ' ') as ngram
  from words, unnest(range(1, (select max(len(regexp_extract_all(lower(term), '[\p{L}\p{N}\p{M}_]+'))) from candidates) + 1)) t(k), unnest(range(1, len(w) - k + 2)) u(i) where len(w) >= k
), counted as (
  select ngram, cast(n as int) as n, count(*) as occurrences, count(distinct doc_id) as records from grams group by 1, 2
)
select *, case when records < 3 then 'rare' when records > 0.05 * (select count(*) from documents) then 'common' else 'useful' end as mark from counted
""")
def p6_ngrams(spark: SparkSession, base: str) -> DataFrame:
    """All n-grams up to the length of the longest candidate term."""
    return frequencies.ngram_frequencies(table(spark, base, "documents"), frequencies.longest_term(table(spark, base, "candidates")))


@query()
def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode_documents(table(spark, base, "documents"))


@query()
def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack_documents(table(spark, base, "documents"))


@query()
def p8_lengths(spark: SparkSession, base: str) -> DataFrame:
    """Containers of several lengths, where a container also costs the square of its length."""
    return packing.pack_documents(table(spark, base, "documents"), cost=packing.ATTENTION)


@query()
def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return languages.wrong_labels(table(spark, base, "documents"))


@query()
def p9_stretches(spark: SparkSession, base: str) -> DataFrame:
    return languages.language_stretches(table(spark, base, "documents")).drop("stretches", "label")
