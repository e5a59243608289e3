"""Fitted equations: forms, parsing of correlations, evaluation inside the validity range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Form codes of the tabular source.
FORM_CODES = {
    "P1": "Linear", "P2": "Polynomial2", "P3": "Polynomial3", "P4": "Polynomial4", "+E": "Arrhenius", "E1": "ExtendedArrhenius1", "E2": "ExtendedArrhenius2",
    "DP": "DiscretePoint", "I1": "Isotherm1", "I2": "Isotherm2", "I3": "Isotherm3", "I4": "Isotherm4",
}
#: Spellings of forms in texts, and coefficients of each form.
SYNONYMS = {
    "linear": "Linear", "polynomial2": "Polynomial2", "poly2": "Polynomial2", "polynomial3": "Polynomial3", "poly3": "Polynomial3",
    "arrhenius": "Arrhenius", "discretepoint": "DiscretePoint", "discrete": "DiscretePoint", "point": "DiscretePoint",
}
ARITY = {"Linear": 2, "Polynomial2": 3, "Polynomial3": 4, "Arrhenius": 2, "DiscretePoint": 2}
GAS = 8.31441


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def form_of_code(code: Column, strict: bool = True) -> Column:
    """The form of a code. An unknown code stops the run (strict) or gives null."""
    form = _map(FORM_CODES)[code]
    return F.coalesce(form, F.raise_error(F.concat(F.lit("unknown equation form code "), F.coalesce(code, F.lit("null")))).cast("string")) if strict else form


def parse_correlation(hint: Column, coefficients: Column, value: Column, temperature: Column, t_min: Column, t_max: Column) -> Column:
    """struct(form, coeffs, t_min, t_max) or null: known form, right number of coefficients, both bounds in order or none."""
    form = _map(SYNONYMS)[F.lower(F.trim(hint))]
    both = t_min.isNotNull() & t_max.isNotNull()
    point = F.struct(form.alias("form"), F.array(value, temperature).alias("coeffs"), temperature.alias("t_min"), temperature.alias("t_max"))
    fit = F.struct(form.alias("form"), coefficients.alias("coeffs"), F.when(both, F.least(t_min, t_max)).alias("t_min"), F.when(both, F.greatest(t_min, t_max)).alias("t_max"))
    return F.when((form == "DiscretePoint") & value.isNotNull() & temperature.isNotNull(), point).when((form != "DiscretePoint") & (F.size(coefficients) == _map(ARITY)[form]), fit)


def value_at(form: Column, c: list[Column], x: Column) -> Column:
    """The equation at x (temperature in kelvin; for isotherms mole percent); null for unknown forms and missing coefficients."""
    c0, c1, c2, c3, c4 = c
    poly = [c0 + c1 * x]
    for k, ck in ((2, c2), (3, c3), (4, c4)):
        poly.append(poly[-1] + ck * F.pow(x, F.lit(float(k))))
    out = F.when(form.isin("Linear", "Isotherm1"), poly[0]).when(form.isin("Polynomial2", "Isotherm2"), poly[1]).when(form.isin("Polynomial3", "Isotherm3"), poly[2])
    return (
        out.when(form.isin("Polynomial4", "Isotherm4"), poly[3])
        .when(form == "Arrhenius", c0 * F.exp(c1 / (F.lit(GAS) * x)))
        .when(form == "ExtendedArrhenius1", c0 * F.exp(c1 / (F.lit(GAS) * x) + c2 / (x * x)))
        .when(form == "ExtendedArrhenius2", c0 * F.exp(c1 / (F.lit(GAS) * (x - c2))))
        .when((form == "DiscretePoint") & (x == c1), c0)
    )


def gated(value: Column, x: Column, t_min: Column, t_max: Column) -> Column:
    """struct(value, status): nothing is extrapolated; status is ok, out-of-range, no-range or no-value."""
    status = F.when(value.isNull(), "no-value").when(t_min.isNull() | t_max.isNull(), "no-range").when(x.between(t_min, t_max), "ok").otherwise("out-of-range")
    return F.struct(F.when(x.between(t_min, t_max), value).alias("value"), status.alias("status"))


def compares(value: Column, comparator: Column, threshold: Column) -> Column:
    """value lt/lte/gt/gte threshold; an unknown comparator or a missing number gives null."""
    return F.when(comparator == "lt", value < threshold).when(comparator == "lte", value <= threshold).when(comparator == "gt", value > threshold).when(comparator == "gte", value >= threshold)
