"""Shape validation: each shape is a query that gives violation rows; a write goes through only if there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.operators.graph import TYPE, core
from saltmarsh.session import cut

#: Predicates that subjects of a type must carry.
REQUIRED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "PropertyMeasurementShape": (("msr:PropertyMeasurement",), ("prov:wasDerivedFrom", "prov:wasGeneratedBy", "msr:dataLocator", "msr:forProperty", "msr:ofSalt", "msr:hasUnit", "msr:equationForm")),
    "MentionShape": (("msr:Mention",), ("msr:inDocument", "msr:startOffset", "msr:endOffset", "msr:surfaceForm", "prov:wasDerivedFrom", "prov:wasGeneratedBy")),
    "CatalogIndividualProvenanceShape": (("msr:MoltenSalt", "msr:Constituent", "msr:ChemicalCompound"), ("prov:wasGeneratedBy", "prov:wasDerivedFrom")),
    "SafetyIndividualProvenanceShape": (("msr:SafetyFunction", "msr:Requirement"), ("prov:wasDerivedFrom", "prov:wasGeneratedBy")),
}
#: Predicates whose objects must be of one of the types.
TARGETS: dict[str, tuple[str, tuple[str, ...]]] = {
    "LinksToTargetKindShape": ("msr:linksTo", ("skos:Concept", "owl:Class", "msr:PhysicalProperty", "msr:MoltenSalt")),
    "ServedByPropertyTargetShape": ("msr:servedByProperty", ("msr:PhysicalProperty",)),
    "AddressesFunctionTargetShape": ("msr:addressesFunction", ("msr:SafetyFunction",)),
}
#: Bounds of a measurement's range.
LOW, HIGH = "msr:validTempMin", "msr:validTempMax"
SCHEMA = ["focus_node", "constraint", "shape", "path", "value", "message"]


def _row(shape: str, constraint: str, path, value, message) -> list:
    return [F.col("s").alias("focus_node"), F.lit(constraint).alias("constraint"), F.lit(shape).alias("shape"), path.alias("path"), value.alias("value"), message.alias("message")]


def by_subject(triples: DataFrame) -> DataFrame:
    """Violations that follow from the triples of one subject: required predicates and ranges of all shapes, in one pass and one shuffle."""
    predicates = sorted({p for _, required in REQUIRED.values() for p in required})
    own = triples.where((F.col("p") == TYPE) | F.col("p").isin(*predicates, LOW, HIGH))
    num = F.col("o").try_cast("double")
    is_a = lambda types: F.bool_or((F.col("p") == TYPE) & F.col("o").isin(*types))
    g = own.groupBy("s").agg(
        *[is_a(types).alias(f"_t{i}") for i, (types, _) in enumerate(REQUIRED.values())], *[F.bool_or(F.col("p") == p).alias(f"_p{i}") for i, p in enumerate(predicates)],
        F.max(F.when(F.col("p") == LOW, num)).alias("lo"), F.min(F.when(F.col("p") == HIGH, num)).alias("hi"),
    )
    none, found = F.lit(None).cast("string"), []
    for i, (shape, (_, required)) in enumerate(REQUIRED.items()):
        for p in required:
            row = F.struct(F.lit("minCount").alias("constraint"), F.lit(shape).alias("shape"), F.lit(p).alias("path"), none.alias("value"), F.lit(f"must carry {p}").alias("message"))
            found.append(F.when(F.col(f"_t{i}") & ~F.col(f"_p{predicates.index(p)}"), row))
    measured = list(REQUIRED).index("PropertyMeasurementShape")
    row = F.struct(F.lit("sparql").alias("constraint"), F.lit("ValidTemperatureRangeShape").alias("shape"), none.alias("path"), F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("value"), F.lit("both bounds must be there, the lower not above the upper").alias("message"))
    found.append(F.when(F.col(f"_t{measured}") & ((F.col("lo") > F.col("hi")) | (F.col("lo").isNull() != F.col("hi").isNull())), row))
    return g.select(F.col("s").alias("focus_node"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v")).select("focus_node", "v.*")


def wrong_target(triples: DataFrame, shape: str, predicate: str, types: tuple[str, ...]) -> DataFrame:
    """A row for each object of the predicate that is of none of the types, asserted types only."""
    good = triples.where((F.col("p") == TYPE) & F.col("o").isin(*types)).select(F.col("s").alias("o")).distinct()
    rows = triples.where(F.col("p") == predicate).select("s", "o").distinct().join(good, "o", "left_anti")
    return rows.select(*_row(shape, "class", F.lit(predicate), F.col("o"), F.lit(f"the target of {predicate} must exist and be of one of the types {', '.join(types)}")))


def unit_not_allowed(triples: DataFrame, allowed: DataFrame) -> DataFrame:
    """Measurements with a unit outside the allowlist (unit)."""
    own = triples.where((F.col("p") == TYPE) & (F.col("o") == "msr:PropertyMeasurement")).select("s").distinct()
    rows = triples.where(F.col("p") == "msr:hasUnit").select("s", "o").distinct().join(own, "s", "left_semi").join(allowed.select(F.col("unit").alias("o")).distinct(), "o", "left_anti")
    return rows.select(*_row("PropertyMeasurementUnitAllowlistShape", "in", F.lit("msr:hasUnit"), F.col("o"), F.lit("the unit must be one of the allowed units")))


def validate(quads: DataFrame, allowed_units: DataFrame | None = None) -> DataFrame:
    """All violations of the core: focus_node, constraint, shape, path, value, message. The core is merged once for all shapes."""
    t = cut(core(quads))
    parts = [by_subject(t)] + [wrong_target(t, n, *x) for n, x in TARGETS.items()]
    if allowed_units is not None:
        parts.append(unit_not_allowed(t, allowed_units))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Rejected(ValueError):
    """A write that would break a shape; carries up to 20 violations for the message."""

    def __init__(self, rows: list) -> None:
        super().__init__("; ".join(f"{r['focus_node']}: {r['message']}" for r in rows))
        self.rows = rows


def commit(store, name: str, after: DataFrame, allowed_units: DataFrame | None = None) -> None:
    """Write quads to a snapshot store if no shape is broken; else nothing changes."""
    bad = validate(after, allowed_units).limit(20).collect()
    if bad:
        raise Rejected(bad)
    store.write({name: after}, {name: "g"})
