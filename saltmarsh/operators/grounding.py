"""Questions answered from graph facts and the measurement store in one plan: ground, look up, gate, evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.equations import compares, gated, value_at
from saltmarsh.operators.graph import pivot


def measurements_view(triples: DataFrame) -> DataFrame:
    return pivot(triples, "msr:PropertyMeasurement", {
        "msr:ofSalt": "salt", "msr:forProperty": "property", "msr:dataLocator": "locator", "msr:equationForm": "form", "msr:hasUnit": "unit", "msr:validTempMin": "valid_min", "msr:validTempMax": "valid_max", "prov:wasDerivedFrom": "source",
    })


def ground(triples: DataFrame, surface: str, digits: str | None = None, prop: str | None = None) -> DataFrame:
    """Measurements of salts that a mention with the surface links to; property by local name; unit label, dataset label and DOI where there are any."""
    mentions = pivot(triples, "msr:Mention", {"msr:surfaceForm": "surface", "msr:linksTo": "salt"})
    hit = mentions.where(F.contains(F.lower("surface"), F.lit(surface.lower()))).select("salt").distinct()
    m = measurements_view(triples).join(hit, "salt", "left_semi")
    if digits:
        m = m.where(F.contains("salt", F.lit(digits)))
    if prop:
        m = m.where(F.lower(F.regexp_extract("property", "([^#/:]*)$", 1)) == prop.lower())
    by = lambda p, a, b: triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    m = m.join(by("rdfs:label", "unit", "unit_label"), "unit", "left").join(by("rdfs:label", "source", "source_label"), "source", "left").join(by("dcterms:identifier", "source", "doi"), "source", "left")
    return m.distinct()


def evaluate(measurements: DataFrame, values: DataFrame, at: Column | float) -> DataFrame:
    """measurements (locator) with the coefficients of the store and (value, status) at a temperature; outside its range nothing is given."""
    t = at if isinstance(at, Column) else F.lit(float(at))
    v = values.select("locator", "equation_form", *[f"c{i}" for i in range(5)], "t_min", "t_max")
    j = measurements.join(v, "locator")
    got = gated(value_at(F.col("equation_form"), [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) if i else F.col("c0") for i in range(5)], t), t, F.col("t_min"), F.col("t_max"))
    return j.withColumn("_g", got).select(*measurements.columns, "equation_form", t.alias("temperature"), F.col("_g.value").alias("value"), F.col("_g.status").alias("status"))


def best_candidate(evaluated: DataFrame, group: str, what: str) -> DataFrame:
    """group, the candidate with the largest value and the value; candidates without a value take no part, ties go to the smaller name."""
    top = F.min(F.struct((-F.col("value")).alias("v"), F.col(what))).alias("top")
    return evaluated.where("value is not null").groupBy(group).agg(top).select(group, f"top.{what}", (-F.col("top.v")).alias("value"))


def gaps(salts: DataFrame, properties: list[str], measurements: DataFrame) -> DataFrame:
    """salt, property of every property of the vocabulary of which a salt (salt) has no measurement (salt, property)."""
    wanted = salts.select("salt").distinct().select("salt", F.explode(F.array(*map(F.lit, properties))).alias("property"))
    return wanted.join(measurements.select("salt", "property").distinct(), ["salt", "property"], "left_anti")


def lacking(properties: DataFrame, measurements: DataFrame, salt: str) -> DataFrame:
    """Properties (property) of which one salt has no measurement."""
    return properties.join(measurements.where(F.col("salt") == salt), "property", "left_anti")


def margins(requirements: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Requirements (requirement, property, comparator, threshold) against values of their property: met and margin.

    The property is an equi-join key, so no product of all requirements with all values is made.
    """
    j = requirements.join(evaluated, "property")
    up = F.col("comparator").isin("gt", "gte")
    return j.withColumn("met", compares(F.col("value"), F.col("comparator"), F.col("threshold"))).withColumn("margin", F.when(up, F.col("value") - F.col("threshold")).otherwise(F.col("threshold") - F.col("value")))


def safety_chain(triples: DataFrame) -> DataFrame:
    """safety_function, property, measurement, salt and the sources of both: what serves a function, with its evidence."""
    served = triples.where("p = 'msr:servedByProperty'").select(F.col("s").alias("safety_function"), F.col("o").alias("property"))
    sources = triples.where("p = 'prov:wasDerivedFrom'").select(F.col("s").alias("safety_function"), F.col("o").alias("function_source"))
    m = measurements_view(triples).select(F.col("s").alias("measurement"), "property", "salt", F.col("source").alias("measurement_source"))
    return served.join(sources, "safety_function").join(m, "property").distinct()


def referenced_locators(scripts: DataFrame, locators: DataFrame) -> DataFrame:
    """script_id, locator of locators that a script holds as a whole: `base@900` holds no `base`.

    Scripts are cut at blanks, quotes and brackets, and the pieces are joined by equality instead of testing all pairs.
    """
    pieces = scripts.select("script_id", F.explode(F.array_distinct(F.split("script", r"[\s'\"()\[\],;]+"))).alias("locator"))
    return pieces.join(locators.select("locator").distinct(), "locator", "left_semi").select("script_id", "locator").distinct()


def rolled_up(turns: DataFrame) -> DataFrame:
    """turn_id with sorted sets of locators, sources and identifiers over its tool results, and whether any is grounded."""
    s = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  # results of one turn
    return turns.groupBy("turn_id").agg(s("locators"), s("cited"), s("dois"), F.bool_or("grounded").alias("grounded"))
