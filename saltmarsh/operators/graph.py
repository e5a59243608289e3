"""Named-graph quads as one table: views, set writes, closure, neighbourhood, routing.

Columns: g, s, p, o, o_type (uri or literal), datatype, lang; stored partitioned by g, so that a graph restriction
prunes files. A quad is identified by all seven columns; null datatype and lang are values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.session import written

COLUMNS = ["g", "s", "p", "o", "o_type", "datatype", "lang"]
CORE = ("ontology", "data", "vocab")
KNOWN = (*CORE, "staging")
TYPE = "rdf:type"
#: Rounds of a closure before it is given up as endless; a hierarchy this deep is an error.
DEEPEST = 200
#: Rounds of a closure kept apart.
MERGED = 12


def core(quads: DataFrame, graphs: tuple[str, ...] = CORE) -> DataFrame:
    """The merged core: triples of the core graphs without the graph, each once, as a default graph shows them."""
    return quads.where(F.col("g").isin(*graphs)).drop("g").distinct()


def graph(quads: DataFrame, name: str) -> DataFrame:
    return quads.where(F.col("g") == name)


def insert(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Set union: inserting twice is inserting once."""
    return quads.select(COLUMNS).unionByName(new.select(COLUMNS)).distinct()


def remove(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """Set difference on all columns; nulls match nulls."""
    return quads.select(COLUMNS).subtract(gone.select(COLUMNS))


def delete_where(quads: DataFrame, condition: Column) -> DataFrame:
    """All quads for which the condition isn't true."""
    return quads.where(~F.coalesce(condition, F.lit(False)))


def put(quads: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Replace a whole graph; a graph of another name is refused."""
    if name not in KNOWN:
        raise ValueError(f"unknown graph {name!r}")
    return quads.where(F.col("g") != name).select(COLUMNS).unionByName(new.withColumn("g", F.lit(name)).select(COLUMNS).distinct())


def replace_value(quads: DataFrame, g: str, subjects: DataFrame, predicate: str, value: str) -> DataFrame:
    """One value for a predicate of the subjects in a graph; other values of it go. subjects: s."""
    own = (F.col("g") == g) & (F.col("p") == predicate)
    marked = quads.join(subjects.select("s").distinct().withColumn("_hit", F.lit(True)), "s", "left")
    kept = marked.where(~(own & F.col("_hit").isNotNull())).select(COLUMNS)
    new = subjects.select("s").distinct().select(F.lit(g).alias("g"), "s", F.lit(predicate).alias("p"), F.lit(value).alias("o"), F.lit("literal").alias("o_type"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return kept.unionByName(new)


def typed(triples: DataFrame, *types: str) -> DataFrame:
    """s of the given types."""
    return triples.where((F.col("p") == TYPE) & F.col("o").isin(*types)).select("s").distinct()


def pivot(triples: DataFrame, type_: str, predicates: dict[str, str]) -> DataFrame:
    """One row for each subject of a type, a column for each predicate (name by predicate); of several values the least."""
    aggs = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for p, c in predicates.items()]
    own = triples.where(F.col("p").isin(TYPE, *predicates))
    return own.groupBy("s").agg(F.bool_or((F.col("p") == TYPE) & (F.col("o") == type_)).alias("_t"), *aggs).where("_t").drop("_t")


def labels(triples: DataFrame, predicates: tuple[str, ...] = ("rdfs:label", "skos:prefLabel", "skos:altLabel")) -> DataFrame:
    """s, labels (sorted, distinct), of all label predicates."""
    return triples.where(F.col("p").isin(*predicates)).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("labels"))  # labels of one entity


def closure(edges: DataFrame, starts: DataFrame, reflexive: bool = True) -> DataFrame:
    """(start, node) reachable over edges (src, dst) from starts (node); a reflexive closure holds each start, with or without edges.

    The frontier is joined round by round and what was seen is taken off, so cycles end. Each round is written once, as
    rows of its own; what was seen is the union of the rounds, which is never written again.
    """
    e = written(edges.select("src", "dst").distinct(), "edges")
    begin = starts.select("node").distinct()
    if reflexive:
        frontier = written(begin.select(F.col("node").alias("start"), "node"), "round")
    else:
        frontier = written(begin.join(e, begin["node"] == e["src"]).select(F.col("node").alias("start"), F.col("dst").alias("node")).distinct(), "round")
    seen = [frontier]
    for _ in range(DEEPEST):
        found = frontier.join(e, frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        for rows in seen:
            found = found.join(rows, ["start", "node"], "left_anti")
        frontier = written(found, "round")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, seen)
        seen.append(frontier)
        if len(seen) > MERGED:  # a deep hierarchy: its rounds are put together, so a plan never holds many of them
            seen = [written(reduce(DataFrame.unionByName, seen), "rounds")]
    raise ValueError(f"a path of more than {DEEPEST} steps")


SAFE_IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+$"


def referenced(triples: DataFrame) -> DataFrame:
    """iri: distinct safe IRIs in subject or object place."""
    both = triples.select(F.col("s").alias("iri")).unionByName(triples.where("o_type = 'uri'").select(F.col("o").alias("iri")))
    return both.where(F.col("iri").rlike(SAFE_IRI)).distinct()


def neighbourhood(quads: DataFrame, subjects: DataFrame, graphs: tuple[str, ...] = CORE) -> DataFrame:
    """Quads of the graphs about the subjects (iri); a triple held by two graphs comes twice."""
    return quads.where(F.col("g").isin(*graphs)).join(subjects.select(F.col("iri").alias("s")).distinct(), "s", "left_semi").select(COLUMNS)


def routed(proposal: DataFrame) -> DataFrame:
    """Quads of a proposal copied to the graphs they belong to: vocab, ontology (both may take one), else data."""
    kinds = proposal.where(F.col("p") == TYPE).groupBy("s").agg(
        F.bool_or(F.col("o") == "skos:Concept").alias("_c"),
        F.bool_or(F.col("o").isin("owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty", "msr:PhysicalProperty")).alias("_o"),
    )
    q = proposal.join(kinds, "s", "left")
    vocab = F.coalesce("_c", F.lit(False)) | F.startswith("p", F.lit("skos:"))
    ontology = F.coalesce("_o", F.lit(False)) | F.col("p").isin("rdfs:subClassOf", "rdfs:domain", "rdfs:range")
    to = F.filter(F.array(F.when(vocab, "vocab"), F.when(ontology, "ontology"), F.when(~(vocab | ontology), "data")), lambda x: x.isNotNull())
    return q.withColumn("g", F.explode(to)).select(COLUMNS).distinct()


def overlay(proposed: DataFrame, present: DataFrame) -> DataFrame:
    """s, p, o of both, with in_proposal, added (edge) and node_added (its subject is new)."""
    a = proposed.select("s", "p", "o").distinct().withColumn("in_proposal", F.lit(True))
    b = present.select("s", "p", "o").distinct().withColumn("in_core", F.lit(True))
    old = present.select("s").distinct().withColumn("_known", F.lit(True))
    j = a.join(b, ["s", "p", "o"], "full").join(old, "s", "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select("s", "p", "o", f("in_proposal").alias("in_proposal"), (f("in_proposal") & ~f("in_core")).alias("added"), (f("in_proposal") & ~f("_known")).alias("node_added"))


def most_common_subject(triples: DataFrame, order: str) -> DataFrame:
    """The subject with most triples; of equals the first by `order`."""
    g = triples.groupBy("s").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(1).select("s", "n")


def entity_quads(rows: DataFrame, g: str, subject: str, type_: str | None, predicates: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """Quads of entity rows: predicates maps a column to (predicate, uri or literal, datatype). Null cells give no quad."""
    parts = [F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o"), F.lit(k).alias("o_type"), F.lit(d).cast("string").alias("datatype")) for c, (p, k, d) in predicates.items()]
    if type_:
        parts.insert(0, F.struct(F.lit(TYPE).alias("p"), F.lit(type_).alias("o"), F.lit("uri").alias("o_type"), F.lit(None).cast("string").alias("datatype")))
    x = rows.select(F.col(subject).alias("s"), F.explode(F.array(*parts)).alias("t")).where("s is not null and t.o is not null")
    return x.select(F.lit(g).alias("g"), "s", "t.p", "t.o", "t.o_type", "t.datatype", F.lit(None).cast("string").alias("lang")).distinct()


def generated_by(facts: DataFrame, run: str, started_at: str, agent: str) -> DataFrame:
    """The provenance of one run: its activity and an edge for each fact (s). The time is passed in, so a rerun gives the same quads."""
    spark = facts.sparkSession
    own = spark.createDataFrame(
        [("provenance", run, TYPE, "prov:Activity", "uri", None, None), ("provenance", run, "prov:startedAtTime", started_at, "literal", "xsd:dateTime", None), ("provenance", run, "prov:wasAssociatedWith", agent, "uri", None, None)],
        ", ".join(f"{c} string" for c in COLUMNS),
    )
    edges = facts.select("s").distinct().select(F.lit("provenance").alias("g"), "s", F.lit("prov:wasGeneratedBy").alias("p"), F.lit(run).alias("o"), F.lit("uri").alias("o_type"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return own.unionByName(edges)


def graph_counts(quads: DataFrame) -> DataFrame:
    return quads.groupBy("g").agg(F.count("*").alias("triples"))


def provenance_columns(df: DataFrame) -> list[str]:
    """Columns whose names say that they carry provenance."""
    return [c for c in df.columns if any(k in c.lower() for k in ("locator", "cited", "doi", "identifier"))]


def provenance_of(df: DataFrame) -> DataFrame:
    """One row: the sorted distinct values of each provenance column, and whether there are any."""
    cols = provenance_columns(df)
    sets = [F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in cols]
    if not cols:
        return df.sparkSession.range(1).select(F.lit(False).alias("grounded"))
    return df.agg(*sets).withColumn("grounded", sum((F.size(c) for c in cols), F.lit(0)) > 0)


def schema_lines(triples: DataFrame) -> DataFrame:
    """One row: classes, properties and concepts as sorted lines of a prompt."""
    kinds = {"owl:Class": "class", "owl:ObjectProperty": "property", "owl:DatatypeProperty": "property", "msr:PhysicalProperty": "quantity", "skos:Concept": "concept"}
    k = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    named = triples.where((F.col("p") == TYPE) & F.col("o").isin(*kinds)).select("s", k[F.col("o")].alias("kind")).distinct().join(labels(triples), "s", "left")
    line = F.concat_ws(" ", "kind", "s", F.concat(F.lit("("), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), "; "), F.lit(")")))
    return named.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("prompt"))  # the schema, which a prompt must hold
