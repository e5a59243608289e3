"""Proposals as quads, edits of a proposal, acceptance against the core, and predicates on names that come from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions.text import local_name, term_slug
from saltmarsh.operators.graph import entity_quads, pivot, typed

LABEL = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"
TYPE_REF = r"^(?:[A-Za-z][\w-]*:)?[A-Za-z][\w-]*$"
#: Documents of each genre belong to a corpus.
CORPUS = {"chemistry": "corpus:chemistry", "safety": "corpus:safety"}


def safe_label(c: Column) -> Column:
    return F.coalesce(c.rlike(LABEL), F.lit(False))


def safe_type(c: Column) -> Column:
    return F.coalesce(c.rlike(TYPE_REF), F.lit(False))


def corpus_of(genre: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CORPUS.items() for x in kv])[genre], F.lit("corpus:general"))


def document_slug(iri: Column) -> Column:
    """What stands behind the last `#` or `/`, as a slug."""
    return term_slug(F.regexp_extract(iri, r"([^#/]*)$", 1))


def unit_guarded(proposals: DataFrame, units: DataFrame, kinds: DataFrame) -> DataFrame:
    """Proposals (unit, quantity_kind) whose asserted unit (unit) and quantity kind (quantity_kind) are on the allowlists; what asserts none passes."""
    u = units.select("unit").distinct().withColumn("_u", F.lit(True))
    k = kinds.select("quantity_kind").distinct().withColumn("_k", F.lit(True))
    j = proposals.join(u, "unit", "left").join(k, "quantity_kind", "left")
    return j.where((F.col("unit").isNull() | F.col("_u").isNotNull()) & (F.col("quantity_kind").isNull() | F.col("_k").isNotNull())).select(proposals.columns)


def bundle(candidates: DataFrame) -> DataFrame:
    """Staging quads of candidates (term, kind, run_id, generated_at, evidence, observations): proposal, evidence and observation nodes.

    Identifiers follow from what the nodes are about: a proposal from its kind and term, evidence from its report and
    offsets, an observation from proposal, document and run. So the same run written twice changes nothing, and another
    run's observation of a document stands beside the first. Evidence and observations are exploded, never gathered.
    Rows of evidence without report or offsets and observations without document have no node.
    """
    slug = term_slug(F.col("term"))
    c = candidates.withColumns({
        "name": F.concat(F.col("kind"), F.lit("-"), slug), "status": F.lit("pending"), "run": term_slug(F.coalesce("run_id", F.lit(""))), "at": F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }).withColumns({"id": F.concat(F.lit("msrd:proposal-"), F.col("name")), "graph": F.concat(F.lit("urn:msr:proposal/"), F.col("name"))})
    literal = lambda p, t="xsd:string": (p, "literal", t)
    uri = lambda p: (p, "uri", None)
    out = entity_quads(c, "staging", "id", "msr:ChangeProposal", {"kind": literal("msr:kind"), "term": literal("msr:term"), "status": literal("msr:reviewStatus"), "graph": literal("msr:hasProposalGraph", "xsd:anyURI")})
    e = c.select("id", F.explode("evidence").alias("e")).select("id", "e.*")
    e = e.withColumn("node", F.concat(F.lit("msrd:evidence-"), F.col("report"), F.lit("-"), F.col("start_offset").cast("string"), F.lit("-"), F.col("end_offset").cast("string"))).where("node is not null")
    out = out.unionByName(entity_quads(e, "staging", "id", None, {"node": uri("msr:hasEvidence")}))
    out = out.unionByName(entity_quads(e, "staging", "node", "msr:Evidence", {"sentence_text": literal("msr:evidenceText"), "document_iri": uri("msr:citedIn"), "start_offset": literal("msr:startOffset", "xsd:integer"), "end_offset": literal("msr:endOffset", "xsd:integer")}))
    o = c.select("id", "name", "run", "at", F.explode("observations").alias("o")).select("id", "name", "run", "at", "o.*").where("document_iri is not null")
    o = o.withColumn("node", F.concat(F.lit("msrd:obs-"), F.col("name"), F.lit("-"), document_slug(F.col("document_iri")), F.lit("-"), F.col("run"))).withColumn("activity", F.when(F.col("run") != "", F.concat(F.lit("msrd:run-"), F.col("run"))))
    out = out.unionByName(entity_quads(o, "staging", "id", None, {"node": uri("msr:hasObservation")}))
    return out.unionByName(entity_quads(o, "staging", "node", "msr:Observation", {
        "document_iri": uri("msr:inDocument"), "corpus": uri("msr:inCorpus"), "occurrence_count": literal("msr:occurrenceCount", "xsd:integer"), "activity": uri("msr:observedInRun"), "at": literal("prov:generatedAtTime", "xsd:dateTime"),
    })).distinct()


def observation_rows(quads: DataFrame) -> DataFrame:
    """proposal_id, document, corpus, occurrence_count, generated_at of the observation nodes of staging: what the review queue reads."""
    s = quads.where("g = 'staging'")
    o = pivot(s, "msr:Observation", {"msr:inDocument": "document", "msr:inCorpus": "corpus", "msr:occurrenceCount": "n", "prov:generatedAtTime": "generated_at"})
    of = s.where("p = 'msr:hasObservation'").select(F.col("s").alias("proposal_id"), F.col("o").alias("s"))
    return of.join(o, "s").select("proposal_id", "document", F.coalesce("corpus", F.lit("")).alias("corpus"), F.coalesce(F.col("n").cast("int"), F.lit(0)).alias("occurrence_count"), "generated_at")


def document_quads(documents: DataFrame, g: str = "data") -> DataFrame:
    """Nodes of documents (report, title, date, genre) with their corpus."""
    d = documents.withColumns({"id": F.concat(F.lit("msrd:"), F.col("report")), "corpus": corpus_of(F.col("genre"))})
    return entity_quads(d, g, "id", "msr:Document", {"title": ("dcterms:title", "literal", None), "report": ("dcterms:identifier", "literal", None), "date": ("dcterms:date", "literal", None), "corpus": ("msr:inCorpus", "uri", None)})


def accepted(individuals: DataFrame, triples: DataFrame) -> DataFrame:
    """individuals (iri, broader) with accepted: their broader class is a class or concept of the core, by IRI or local name."""
    known = typed(triples, "owl:Class", "skos:Concept", "msr:PhysicalProperty").select(F.col("s").alias("broader"))
    both = known.unionByName(known.select(local_name(F.col("broader")).alias("broader"))).distinct().withColumn("_in", F.lit(True))
    return individuals.join(both, "broader", "left").withColumn("accepted", F.coalesce("_in", F.lit(False)) & safe_type(F.col("broader"))).drop("_in")


def edited(quads: DataFrame, s: str, p: str, value: str | None) -> DataFrame:
    """A field of a proposal set, added or (None) removed: the first value is replaced, others stay."""
    own = (F.col("s") == s) & (F.col("p") == p)
    rest, hit = quads.where(~own), quads.where(own)
    if value is None:
        return rest
    n = F.row_number().over(Window.partitionBy("s", "p").orderBy("o"))  # values of one field
    changed = hit.withColumn("_n", n).withColumn("o", F.when(F.col("_n") == 1, value).otherwise(F.col("o"))).drop("_n")
    if hit.isEmpty():
        changed = quads.sparkSession.createDataFrame([("staging", s, p, value, "literal", None, None)], quads.schema)
    return rest.unionByName(changed)


def truncated(text: Column, lines: int = 50, size: int = 4096) -> Column:
    """struct(text, truncated): the first lines, then the first bytes; a character that the last byte would cut is left out."""
    parts = F.split(text, "\n")
    more = F.size(parts) > lines
    cut = F.array_join(F.slice(parts, 1, lines), "\n")
    cut = F.when(more, F.concat(cut, F.lit("\n"))).otherwise(cut)
    # the longest beginning of whole characters: bytes that begin no character follow at most three times
    data = F.encode(cut, "UTF-8")
    begins = lambda k: (F.conv(F.hex(F.substring(data, F.lit(size + 1) - k, F.lit(1))), 16, 10).cast("int").bitwiseAND(0xC0)) != 0x80
    keep = F.when(begins(0), size).when(begins(1), size - 1).when(begins(2), size - 2).otherwise(size - 3)
    short = F.decode(F.substring(data, F.lit(1), keep), "UTF-8")
    long = F.octet_length(cut) > size
    return F.struct(F.when(long, short).otherwise(cut).alias("text"), (more | long).alias("truncated"))


def merged_catalog(constituents: DataFrame, labels: DataFrame) -> DataFrame:
    """iri, labels, parts of salts that have either: a full join of both sides, each gathered by salt."""
    a = constituents.groupBy("iri").agg(F.array_sort(F.collect_set("compound")).alias("parts"))  # components of one salt
    b = labels.groupBy("iri").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # labels of one salt
    empty = F.array().cast("array<string>")
    return a.join(b, "iri", "full").select("iri", F.coalesce("labels", empty).alias("labels"), F.coalesce("parts", empty).alias("parts"))


def bridged_chunks(chunks: DataFrame, gap: str = "bridge") -> DataFrame:
    """report, start, end, n of runs of chunks (report, sentence, start, end, bridge): a chunk whose `bridge` is true continues the one before."""
    w = Window.partitionBy("report", "sentence").orderBy("start")  # chunks of one sentence
    k = F.sum(F.when(F.col(gap), 0).otherwise(1)).over(w)
    return chunks.withColumn("_k", k).groupBy("report", "sentence", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_k")
