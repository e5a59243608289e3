"""Proposed relations: validation with ordered reasons, grounding, the best of each key, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions.equations import ARITY, SYNONYMS, _map
from saltmarsh.functions.chem import slug
from saltmarsh.functions.numbers import confidence, shortest
from saltmarsh.functions.text import local_name
from saltmarsh.operators.graph import entity_quads

#: Fields of a proposal; numbers are taken as texts, so a wrong type can be told from a missing one.
PROPOSAL = "kind string, salt string, property string, unit string, role string, reactor string, safety_function string, requirement string, confidence double, rationale string, form_hint string, coefficients array<double>, value double, temperature double, t_min double, t_max double"
#: Spellings of units by the property they measure.
UNIT_PROPERTY = {"cP": "viscosity", "mPa.s": "viscosity", "mPas": "viscosity", "g/cm3": "density", "g/cc": "density", "mN/m": "surfaceTension", "S/cm": "electricalConductivity"}
#: The property's own unit.
UNIT_CURIE = {"density": "unit:GM-PER-CentiM3", "viscosity": "unit:MilliPA-SEC", "surfaceTension": "unit:MilliN-PER-M", "electricalConductivity": "unit:S-PER-CentiM"}


def proposals(replies: DataFrame, column: str = "reply") -> DataFrame:
    """One row a proposal of JSON replies `{"relations": [...]}`; a reply that is no such text gives one row with malformed."""
    parsed = F.from_json(F.col(column), f"relations array<struct<{', '.join(f.replace(' ', ':', 1) for f in PROPOSAL.split(', '))}>>")
    r = replies.withColumn("_r", parsed["relations"])
    each = r.withColumn("_p", F.explode_outer("_r")).withColumn("malformed", F.col("_r").isNull())
    return each.select(*[c for c in replies.columns if c != column], "malformed", "_p.*")


def resolve_unit(unit: Column, prop: Column, allowed: tuple[str, ...] = tuple(UNIT_CURIE.values())) -> Column:
    """struct(curie, reason): reason is unmappable, out-of-allowlist or dimension-mismatch, else empty. Case counts."""
    text = F.replace(F.translate(F.trim(unit), "·³μ", ".3u"), F.lit(""), F.lit(""))
    of = _map(UNIT_PROPERTY)[text]
    curie = _map(UNIT_CURIE)[of]
    reason = F.when(of.isNull() | curie.isNull(), "unmappable").when(~curie.isin(*allowed), "out-of-allowlist").when(F.coalesce(_map(UNIT_CURIE)[prop] != curie, F.lit(True)), "dimension-mismatch").otherwise("")
    return F.struct(F.when(reason == "", curie).alias("curie"), reason.alias("reason"))


def validated(rows: DataFrame, known: dict[str, DataFrame], threshold: float, mentions: DataFrame | None = None) -> DataFrame:
    """rows with confidence, disposition (written, rejected, skipped), reason and unit_iri.

    known: iri tables salts, properties, roles, reactors, functions, requirements. Checks go in a fixed order and the
    first that fails gives the reason. A reactor must be mentioned in the same segment (mentions: report, seg_index,
    target_iri). Membership is a left join on distinct keys, which Spark broadcasts where the set is small.
    """
    out = rows.withColumn("confidence", confidence(F.col("confidence")))
    for name, column in (("salts", "salt"), ("properties", "property"), ("roles", "role"), ("reactors", "reactor"), ("functions", "safety_function"), ("requirements", "requirement")):
        if name in known:
            out = out.join(known[name].select(F.col("iri").alias(column)).distinct().withColumn(f"_{name}", F.lit(True)), column, "left")
        else:
            out = out.withColumn(f"_{name}", F.lit(None).cast("boolean"))
    if mentions is not None:
        seen = mentions.select("report", "seg_index", F.col("target_iri").alias("reactor")).distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, ["report", "seg_index", "reactor"], "left")
    else:
        out = out.withColumn("_seen", F.lit(None).cast("boolean"))
    known_ = lambda n: F.coalesce(F.col(f"_{n}"), F.lit(False))
    unit = resolve_unit(F.col("unit"), local_name(F.col("property")))
    form = _map(SYNONYMS)[F.lower(F.trim("form_hint"))]
    fits = F.when(form == "DiscretePoint", F.col("value").isNotNull() & F.col("temperature").isNotNull()).otherwise(F.size("coefficients") == _map(ARITY)[form])
    k = F.col("kind")
    lacks = lambda *c: F.greatest(*[F.col(x).isNull() for x in c]) if len(c) > 1 else F.col(c[0]).isNull()
    malformed = (
        F.when(k == "measurement", lacks("salt", "property", "unit")).when(k == "role", lacks("salt", "role")).when(k == "reactor", lacks("salt", "reactor"))
        .when(k == "servedByProperty", lacks("safety_function", "property")).when(k == "addressesFunction", lacks("requirement", "safety_function")).otherwise(True)
    )
    reason = (
        F.when(F.col("confidence") < threshold, "below-threshold")
        .when(malformed, "malformed-relation")
        .when((k == "measurement") & ~known_("salts"), "salt-not-composed")
        .when((k == "measurement") & ~known_("properties"), "unknown-property")
        .when((k == "measurement") & (unit["reason"] != ""), F.concat(F.lit("unit-"), unit["reason"]))
        .when((k == "measurement") & ~F.coalesce(fits, F.lit(False)), "equation-parse")
        .when(k.isin("role", "reactor") & ~known_("salts"), "unknown-salt")
        .when((k == "role") & ~known_("roles"), "unknown-role")
        .when((k == "reactor") & ~(known_("reactors") & F.coalesce("_seen", F.lit(False))), "reactor-not-grounded")
        .when((k == "addressesFunction") & ~known_("requirements"), "unknown-requirement")
        .when(k.isin("servedByProperty", "addressesFunction") & ~known_("functions"), "unknown-safety-function")
        .when((k == "servedByProperty") & ~known_("properties"), "unknown-property")
        .otherwise("")
    )
    out = out.withColumn("reason", reason)
    disposition = F.when(F.col("reason") == "", "written").when(F.col("reason").isin("below-threshold", "salt-not-composed"), "skipped").otherwise("rejected")
    return out.withColumn("disposition", disposition).withColumn("unit_iri", F.when((k == "measurement") & F.col("reason").isin("", "equation-parse"), unit["curie"])).drop(*[c for c in out.columns if c.startswith("_")])


def best_of_key(rows: DataFrame, keys: list[str], order: list[Column], id_column: str) -> DataFrame:
    """rows with disposition and reason: of written rows with one key the first by `order` stays, the others are skipped as duplicate-locator.

    The winner is a min over structs, so each task sends one row a key; losers are found by a join on the row's id.
    """
    cols = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    won = rows.where("disposition = 'written'").groupBy(*keys).agg(F.min(F.struct(*cols, F.col(id_column))).alias("_w")).select(F.col(f"_w.{id_column}").alias(id_column)).withColumn("_won", F.lit(True))
    j = rows.join(won, id_column, "left")
    lost = (F.col("disposition") == "written") & F.col("_won").isNull()
    return j.withColumn("reason", F.when(lost, "duplicate-locator").otherwise(F.col("reason"))).withColumn("disposition", F.when(lost, "skipped").otherwise(F.col("disposition"))).drop("_won")


def selected_sentences(segments: DataFrame, mentions: DataFrame) -> DataFrame:
    """Segments with at least one linked mention and their mentions in order (surface_form, target_iri, target_kind)."""
    own = F.array_sort(F.collect_list(F.struct("char_start", "char_end", "surface_form", "target_iri", "target_kind")))  # mentions of one segment
    m = mentions.where("status = 'linked'").select("doc_id", "seg_index", "char_start", "char_end", "surface_form", "target_iri", "target_kind").distinct().groupBy("doc_id", "seg_index").agg(own.alias("mentions"))
    return segments.join(m, ["doc_id", "seg_index"])


def extraction_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("report").agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in ("written", "rejected", "skipped")], F.count_if(F.col("reason") == "malformed-relation").alias("malformed"))


def edges(written: DataFrame) -> DataFrame:
    """edge_iri, subject, predicate, object, report, confidence, rationale of written role, reactor and linking relations.

    The identifier names report, subject, predicate and object, so a relation found twice is one edge: of its rows the
    most confident one stays.
    """
    k = F.col("kind")
    subject = F.when(k == "servedByProperty", F.col("safety_function")).when(k == "addressesFunction", F.col("requirement")).otherwise(F.col("salt"))
    obj = F.when(k == "role", F.col("role")).when(k == "reactor", F.col("reactor")).when(k == "servedByProperty", F.col("property")).when(k == "addressesFunction", F.col("safety_function"))
    name = F.when(k == "role", "hasRole").when(k == "reactor", "usedIn").when(k.isin("servedByProperty", "addressesFunction"), k)
    rows = written.where((F.col("disposition") == "written") & name.isNotNull())
    iri = F.concat(F.lit("msrd:edge-"), F.col("report"), F.lit("-"), slug(local_name(subject)), F.lit("-"), name, F.lit("-"), local_name(obj))
    rows = rows.select(iri.alias("edge_iri"), subject.alias("subject"), F.concat(F.lit("msr:"), name).alias("predicate"), obj.alias("object"), "report", "confidence", "rationale").where("edge_iri is not null")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.coalesce("rationale", F.lit("")).alias("r"), "rationale", "subject", "predicate", "object", "report")).alias("b")
    return rows.groupBy("edge_iri").agg(best).select("edge_iri", "b.subject", "b.predicate", "b.object", "b.report", (-F.col("b.c")).alias("confidence"), "b.rationale")


def edge_quads(found: DataFrame, run: str, g: str = "data") -> DataFrame:
    """The edges of edges() and a statement node for each: what is said, where it was read, by which run, and how surely."""
    fact = found.select(F.lit(g).alias("g"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.lit("uri").alias("o_type"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    d = found.withColumns({"source": F.concat(F.lit("msrd:"), F.col("report")), "run": F.lit(run), "sure": shortest(F.col("confidence"))})
    return fact.unionByName(entity_quads(d, g, "edge_iri", "rdf:Statement", {
        "subject": ("rdf:subject", "uri", None), "predicate": ("rdf:predicate", "uri", None), "object": ("rdf:object", "uri", None), "source": ("prov:wasDerivedFrom", "uri", None),
        "run": ("prov:wasGeneratedBy", "uri", None), "sure": ("msr:confidence", "literal", "xsd:decimal"), "rationale": ("msr:rationale", "literal", "xsd:string"),
    })).distinct()


def trace(validated_rows: DataFrame) -> DataFrame:
    """report, kind, disposition, reason, n: how many proposals of a run took which way."""
    return validated_rows.groupBy("report", "kind", "disposition", "reason").agg(F.count("*").alias("n"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with rank within their key, for reports over keys of bounded size."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
