"""The review queue: observations brought down to the latest of each document, then to one row a proposal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(observations: DataFrame, *keys: str) -> DataFrame:
    """The latest observation of each key by its time as text, as its writers stamp it; of equal times the largest (corpus, count).

    A max over a struct: partial aggregation leaves one row a key in each task before the shuffle.
    """
    top = F.max(F.struct("generated_at", "corpus", "occurrence_count")).alias("top")
    return observations.groupBy(*keys).agg(top, F.min("generated_at").alias("first_observed"), F.max("generated_at").alias("last_observed")).select(
        *keys, "top.corpus", "top.occurrence_count", "first_observed", "last_observed"
    )


def queue(proposals: DataFrame, observations: DataFrame, status: str | None = None) -> DataFrame:
    """proposal_id, kind, status, term, document_frequency, total_occurrences, corpus_count, corpora; proposals without observations have zeros.

    The status filter comes before the aggregation: status belongs to the proposal, so the rows are the same.
    """
    p = proposals if status is None else proposals.where(F.col("status") == status)
    each = latest(observations.where("document is not null and document <> ''"), "proposal_id", "document")
    sums = each.groupBy("proposal_id").agg(
        F.count("*").alias("document_frequency"), F.sum("occurrence_count").alias("total_occurrences"), F.count_distinct("corpus").alias("corpus_count"), F.array_sort(F.collect_set("corpus")).alias("corpora")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return p.join(sums, "proposal_id", "left").select(
        "proposal_id", "kind", "status", "term", zero("document_frequency"), zero("total_occurrences"), zero("corpus_count"), F.coalesce("corpora", F.array().cast("array<string>")).alias("corpora")
    )


def breakdown(observations: DataFrame) -> DataFrame:
    """proposal_id, corpus, document, occurrence_count, first_observed, last_observed: each document under its latest corpus."""
    return latest(observations.where("document is not null"), "proposal_id", "document").select("proposal_id", "corpus", "document", "occurrence_count", "first_observed", "last_observed")


def nested_breakdown(observations: DataFrame) -> DataFrame:
    """proposal_id, corpora: array of struct(corpus, documents), both sorted; for one proposal's detail page."""
    docs = breakdown(observations).groupBy("proposal_id", "corpus").agg(F.array_sort(F.collect_list(F.struct("document", "occurrence_count", "first_observed", "last_observed"))).alias("documents"))
    return docs.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("corpus", "documents"))).alias("corpora"))
