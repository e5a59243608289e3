"""Property tables to measurements: scope, form, canonical salt, validity range, unique locators, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions.chem import canonical_salts, is_fluoride, locator, slug
from saltmarsh.functions.equations import form_of_code
from saltmarsh.functions.numbers import lenient, shortest
from saltmarsh.operators.graph import entity_quads


def unique_locators(rows: DataFrame, base: str, t_min: str, form: str, order: str, text: Column | None = None) -> DataFrame:
    """rows with locator: of rows with one base each gets `@t_min` or `@na`, and `-rank` where that repeats; a base held once stays as it is."""
    g = Window.partitionBy(base)
    rank = F.row_number().over(g.orderBy(F.col(t_min).asc_nulls_first(), form, order))
    suffix = F.concat(F.lit("@"), F.coalesce(text if text is not None else F.col(t_min).cast("string"), F.lit("na")))
    step = rows.withColumns({"_n": F.count("*").over(g), "_rank": rank, "_suffix": suffix})
    again = F.row_number().over(Window.partitionBy(base, "_suffix").orderBy("_rank"))
    step = step.withColumn("_again", again)
    name = F.concat(F.col(base), F.col("_suffix"), F.when(F.col("_again") > 1, F.concat(F.lit("-"), F.col("_rank").cast("string"))).otherwise(""))
    return step.withColumn("locator", F.when(F.col("_n") > 1, name).otherwise(F.col(base))).drop("_n", "_rank", "_suffix", "_again")


def measured(raw: DataFrame, units: dict[str, str], source: str = "nist-srd27") -> DataFrame:
    """All rows of a property table with in_scope, form, the canonical salt or a flag_reason, coefficients c0..c4, t_min, t_max, unit.

    An unknown form code in scope stops the run; a salt without canonical form is only flagged.
    """
    r = raw.withColumn("in_scope", is_fluoride(F.col("salt")))
    r = r.withColumn("form", F.when(F.col("in_scope"), form_of_code(F.col("code"))))
    r = canonical_salts(r, "salt", "composition", "code")
    c = {f"c{i}": lenient(F.col(f"data{i + 1}"), kelvin=True) for i in range(5)}
    low, high = lenient(F.col("t_min")), lenient(F.col("t_max"))
    code = F.col("code")
    t_low = F.when(code == "DP", c["c1"]).otherwise(low)
    t_high = F.when(code == "DP", c["c1"]).when(code.isin("I1", "I2", "I3", "I4"), low).otherwise(high)
    u = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])[F.col("property")]
    return r.withColumns({**c, "t_min": t_low, "t_max": t_high, "unit": u, "base": locator(source, F.col("property"), F.col("canonical"), F.coalesce("is_range", F.lit(False)))})


def kept(rows: DataFrame) -> DataFrame:
    """Measurements in scope with canonical salts, with unique locators and identifiers."""
    k = unique_locators(rows.where("in_scope and flag_reason is null"), "base", "t_min", "form", "row", F.regexp_replace(shortest(F.col("t_min")), r"\.0$", ""))
    return k.withColumn("measurement_iri", F.concat(F.lit("msrd:m-"), slug(F.col("locator"))))


def summary(rows: DataFrame) -> DataFrame:
    """property, read, kept, out_of_scope, flagged, distinct_salts."""
    ok = F.col("in_scope") & F.col("flag_reason").isNull()
    return rows.groupBy("property").agg(F.count("*").alias("read"), F.count_if(ok).alias("kept"), F.count_if(~F.col("in_scope")).alias("out_of_scope"), F.count_if(F.col("in_scope") & F.col("flag_reason").isNotNull()).alias("flagged"), F.count_distinct(F.when(ok, F.col("canonical"))).alias("distinct_salts"))


def forms(rows: DataFrame) -> DataFrame:
    return rows.where("in_scope and flag_reason is null").groupBy("form").agg(F.count("*").alias("n"))


def value_rows(measurements: DataFrame) -> DataFrame:
    """Rows of the measurement store."""
    return measurements.select("locator", F.col("canonical").alias("salt"), "property", *[f"c{i}" for i in range(5)], "t_min", "t_max", F.col("form").alias("equation_form"), "uncertainty", F.lit("nist").alias("source"), F.lit(None).cast("string").alias("doc_id"))


def catalog_quads(measurements: DataFrame) -> DataFrame:
    """Quads of measurements, salts and their constituents, each entity once."""
    m = measurements.withColumns({"form_iri": F.concat(F.lit("msr:"), F.col("form")), "property_iri": F.concat(F.lit("msr:"), F.col("property")), "lo": shortest(F.col("t_min")), "hi": shortest(F.col("t_max"))})
    out = entity_quads(m, "data", "measurement_iri", "msr:PropertyMeasurement", {
        "iri": ("msr:ofSalt", "uri", None), "property_iri": ("msr:forProperty", "uri", None), "form_iri": ("msr:equationForm", "uri", None), "unit": ("msr:hasUnit", "uri", None),
        "locator": ("msr:dataLocator", "literal", "xsd:string"), "lo": ("msr:validTempMin", "literal", "xsd:decimal"), "hi": ("msr:validTempMax", "literal", "xsd:decimal"), "uncertainty": ("msr:uncertainty", "literal", "xsd:string"),
    })
    salts = measurements.select("iri", "label", "constituents").dropDuplicates(["iri"])
    out = out.unionByName(entity_quads(salts, "data", "iri", "msr:MoltenSalt", {"label": ("rdfs:label", "literal", "xsd:string")}))
    parts = salts.select(F.col("iri").alias("salt"), F.explode("constituents").alias("c")).select("salt", F.col("c.iri").alias("part"), F.concat(F.lit("msrd:compound-"), F.col("c.compound")).alias("compound"), F.col("c.compound").alias("name"), *[shortest(F.col(f"c.{x}")).alias(x) for x in ("mole_fraction", "mf_min", "mf_max")])
    out = out.unionByName(entity_quads(parts, "data", "salt", None, {"part": ("msr:hasConstituent", "uri", None)}))
    out = out.unionByName(entity_quads(parts, "data", "part", "msr:Constituent", {
        "compound": ("msr:compound", "uri", None), "mole_fraction": ("msr:moleFraction", "literal", "xsd:decimal"), "mf_min": ("msr:moleFractionMin", "literal", "xsd:decimal"), "mf_max": ("msr:moleFractionMax", "literal", "xsd:decimal"),
    }))
    return out.unionByName(entity_quads(parts.select("compound", "name").distinct(), "data", "compound", "msr:ChemicalCompound", {"name": ("rdfs:label", "literal", "xsd:string")})).distinct()
