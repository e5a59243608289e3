"""Problem 1: one quantity recorded in many units, converted to the property's common unit.

Unit texts are parsed by the grammar of functions.units into scale, offset and a vector of dimension exponents; a
stated unit counts only if its vector is that of the property's common unit. Where a record says nothing about its
unit, the common unit holds unless the number lies outside the span of the property's stated values; then the most
frequent unit of the property that puts it inside holds. The spans come from all stated records.

Defined results: null, NaN and infinite numbers, unknown properties and units of another dimension give no row;
repeated records give one row; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.units import DEGREES, find_unit, parse_form, parse_unit
from saltmarsh.session import written

#: A number this much beyond the span of the stated values of its property (on either side, as a factor) is ruled out.
SPAN_SLACK = 1.5
#: Distinct statements a task remembers.
MOST_HELD = 100_000
#: Unit texts that say nothing (fixed values); everything else that isn't a unit is a wrong statement.
SILENT = ("", "-", "see text")
_SAID, _SILENT, _WRONG = 1, 0, -1


def _target(symbols: dict[str, str]) -> dict[str, tuple]:
    return {p: u for p, s in symbols.items() if (u := parse_unit(s))}


def _temperature(name: str | None) -> tuple[float, float]:
    """T_name = a * T_kelvin + b."""
    scale, offset = DEGREES.get(name or "", DEGREES.get((name or "").replace(".", ""), (1.0, 0.0)))
    return 1 / scale, -offset / scale


def _statement(target: dict[str, tuple], forms: bool, prop: str | None, main: str | None, side: str | None) -> tuple:
    """(state, scale, shift, plain, shift of the temperature) of what a record says about its unit."""
    want = target.get(prop)
    if want is None:
        return _WRONG, None, None, None, None
    temp = None
    if forms:
        _, main, temp = parse_form(main)
    unit, state = None, _SILENT
    if (main or "").strip().lower() not in SILENT:
        unit = parse_unit(main)
        state = _SAID if unit and unit.dim == want.dim else _WRONG
    elif side and (unit := find_unit(side, want.dim)):
        state = _SAID if unit.dim == want.dim else _WRONG
    shift = _temperature(temp)[1]
    if state != _SAID:
        return state, None, None, None, shift
    plain = not (main and main.strip().startswith(("10", "1e", "x1")))
    return state, unit.scale / want.scale, (unit.offset - want.offset) / want.scale, plain, shift


_KEPT = "src string, rec_key string, property string, num double, slope double, sure boolean"
_READ = "state int, scale double, shift double, plain boolean, t_shift double"


def _reader(symbols: dict[str, str]):
    """A function over Arrow batches that adds what each record says about its unit; every distinct statement is parsed once a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = _target(symbols)
        number: dict[tuple, int] = {}
        found: list[tuple] = []
        for b in batches:
            at = []
            for key in zip(*(b.column(c).to_pylist() for c in ("forms", "property", "main", "side"))):
                k = number.get(key)
                if k is None:
                    if len(found) >= MOST_HELD:
                        break
                    k = number[key] = len(found)
                    found.append(_statement(target, *key))
                at.append(k)
            rows = [found[k] for k in at]
            if len(at) < b.num_rows:  # the memory is full: the rest of the batch is read without it
                rows += [_statement(target, *key) for key in zip(*(b.column(c).to_pylist()[len(at):] for c in ("forms", "property", "main", "side")))]
                number.clear()
                found.clear()
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.float64())
            names = [*(x.split()[0] for x in _KEPT.split(", ")), *(x.split()[0] for x in _READ.split(", "))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:6]), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return read


def _common(catalog: DataFrame) -> tuple[dict[str, str], dict[str, int]]:
    """The common units: one row a property, so of the catalogue's size."""
    rows = catalog.select("property", "unit_symbol", "decimals").where("property is not null and unit_symbol is not null").distinct().collect()
    return {r[0]: r[1] for r in rows}, {r[0]: r[2] or 0 for r in rows}


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def to_common_units(relations: DataFrame, values: DataFrame, catalog: DataFrame) -> DataFrame:
    """src, rec_key, property, scaled_value of every record whose number changes in the common unit."""
    symbols, decimals = _common(catalog)
    if not symbols:
        return relations.sparkSession.createDataFrame([], "src string, rec_key string, property string, scaled_value bigint")
    curie = {r[0]: r[1] for r in catalog.select("property", "unit_curie").collect()}
    own = F.create_map(*[F.lit(x) for p, c in curie.items() if c for x in (p, c)]) if any(curie.values()) else F.create_map(F.lit(""), F.lit(""))
    a = relations.where((F.col("relation_kind") == "measurement") & _finite(F.col("val"))).select(
        F.lit("relations").alias("src"), F.col("relation_id").cast("string").alias("rec_key"), F.regexp_replace("property_iri", "^msr:", "").alias("property"), F.col("val").alias("num"),
        F.lit(None).cast("double").alias("slope"), F.lit(False).alias("forms"), F.col("unit").alias("main"), F.col("rationale").alias("side"), "unit_iri",
    ).withColumn("sure", F.coalesce(F.col("unit_iri") == own[F.col("property")], F.lit(False))).drop("unit_iri")
    b = values.where(_finite(F.col("c0"))).select(
        F.lit("measurement_value").alias("src"), F.col("locator").alias("rec_key"), "property", F.col("c0").alias("num"),
        F.when(_finite(F.col("c1")), F.col("c1")).alias("slope"), F.lit(True).alias("forms"), F.col("equation_form").alias("main"), F.col("uncertainty").alias("side"), F.lit(False).alias("sure"),
    )
    read = a.unionByName(b).mapInArrow(_reader(symbols), f"{_KEPT}, {_READ}").where(F.col("state") != _WRONG)
    # a form in another temperature T' = a T + b: c0 + c1 T' = (c0 + c1 b) + ...
    read = read.withColumn("at", F.col("num") + F.coalesce(F.col("slope") * F.col("t_shift"), F.lit(0.0))).drop("slope", "t_shift")
    read = written(read, "quantities")  # read once, used for the spans, for the offers and for the result
    said = read.where(F.col("state") == _SAID)
    spans = said.groupBy("property").agg(
        F.percentile_approx(F.col("num") * F.col("scale") + F.col("shift"), F.array(F.lit(0.002), F.lit(0.998)), 10000).alias("q")
    ).select("property", (F.col("q")[0] / SPAN_SLACK).alias("low"), (F.col("q")[1] * SPAN_SLACK).alias("high"))
    units = said.where("plain").groupBy("property", "scale", "shift").agg(F.count("*").alias("n"))
    silent = read.where(F.col("state") == _SILENT).drop("scale", "shift", "plain")
    silent = silent.join(F.broadcast(spans), "property", "left")  # a row a property of the catalogue
    fits = (F.col("sure") | F.col("low").isNull() | F.col("num").between(F.col("low"), F.col("high")))
    # every unit the property is stated in, the most frequent first; one row a property
    offers = units.groupBy("property").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "scale", "shift"))).alias("offers"))
    odd = silent.where(~fits).join(offers, "property", "left")
    pick = F.filter("offers", lambda o: (F.col("num") * o["scale"] + o["shift"]).between(F.col("low"), F.col("high")))
    odd = odd.withColumn("pick", F.get(pick, F.lit(0))).where("pick is not null")
    plain = ["src", "rec_key", "property", "num", "at"]
    out = (
        said.select(*plain, "scale", "shift")
        .unionByName(silent.where(fits).select(*plain, F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift")))
        .unionByName(odd.select(*plain, F.col("pick.scale").alias("scale"), F.col("pick.shift").alias("shift")))
    )
    digits = F.create_map(*[F.lit(x) for p, d in decimals.items() for x in (p, int(d))])
    got = F.col("at") * F.col("scale") + F.col("shift")
    changed = F.abs(got - F.col("num")) > 1e-9 * F.greatest(F.abs(F.col("num")), F.abs(got))
    scaled = F.round(got * F.pow(F.lit(10.0), digits[F.col("property")]), 0).cast("bigint")
    return out.where(changed).select("src", "rec_key", "property", scaled.alias("scaled_value")).distinct()
