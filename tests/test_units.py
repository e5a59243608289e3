import pytest

from saltmarsh.functions.units import find_unit, parse_form, parse_unit
from saltmarsh.operators.quantities import to_common_units

DENSITY = parse_unit("g/cm3").dim


@pytest.mark.parametrize("text, like, factor", [
    ("kg m-3", "g/cm3", 1e-3), ("lb/ft³", "g/cm3", 0.01601846337), ("10^-3 S/cm", "S/cm", 1e-3), ("x10^3 Ω⁻¹cm⁻¹", "S/cm", 1e3), ("cP", "mPa.s", 1), ("poise", "mPa.s", 100), ("μPa·s", "mPa.s", 1e-3),
    ("cal/(g °C)", "J/(kg.K)", 4184), ("kcal/(kg K)", "J/(kg.K)", 4184), ("J/kg/°C", "J/(kg.K)", 1), ("cal/s-cm-K", "W/(m.K)", 418.4), ("torr", "Pa", 101325 / 760), ("mm Hg", "Pa", 101325 / 760), ("lb/in2", "Pa", 6894.757),
    ("dyn/cm", "mN/m", 1), ("erg/cm2", "mN/m", 1), ("mJ/m²", "mN/m", 1), ("kg per cubic metre", "g/cm3", 1e-3), ("lbm/cu ft", "g/cm3", 0.01601846337), ("1e2 g/cm³", "g/cm3", 100), ("mPas", "mPa.s", 1), ("g/(cm s)", "mPa.s", 100),
])
def test_scale_and_dimension(text, like, factor):
    a, b = parse_unit(text), parse_unit(like)
    assert a.dim == b.dim
    assert a.scale / b.scale == pytest.approx(factor, rel=1e-6)


@pytest.mark.parametrize("text", [None, "", "  ", "%", "???", "furlongs", "arb. units", "counts/s", "see text", "-", "m^99", "1e999 g", "((g)", "g/cm3)"])
def test_no_unit(text):
    assert parse_unit(text) is None


def test_temperature_has_an_offset_only_alone():
    assert parse_unit("°F").scale * 1000 + parse_unit("°F").offset == pytest.approx(810.928, abs=1e-3)
    assert parse_unit("J/kg/°C").offset == 0


@pytest.mark.parametrize("text, scale", [
    ("density of 167 lbm/cu ft read from the text", 16.01846337), ("sentence gives 2,548.7 kg per cubic metre for the melt", 1), ("value quoted in kg/L (1.969) by the authors", 1000),
    ("+/- 41 kg m-3", 1), ("5.3 lb/ft³ (1 sigma)", 16.01846337), ("4.3e+03 g/L (1 sigma)", 1),
])
def test_unit_in_running_text(text, scale):
    assert find_unit(text, DENSITY).scale == pytest.approx(scale, rel=1e-6)


@pytest.mark.parametrize("text", ["+/- 3%", "1.5 pct", "n.r.", "", None, "stated in the sentence"])
def test_no_unit_in_running_text(text):
    assert find_unit(text, DENSITY) is None


@pytest.mark.parametrize("text, want", [
    ("Isotherm3 (kg/L)", ("Isotherm3", "kg/L", None)), ("point in degF", ("point", "degF", None)), ("Linear; T in °C", ("Linear", None, "°C")), ("linear (kg·m⁻³); T[C]", ("linear", "kg·m⁻³", "C")),
    ("linear, values as g/L; t/degC", ("linear", "g/L", "degC")), ("lin.", ("lin.", None, None)), (None, ("", None, None)),
])
def test_form(text, want):
    assert parse_form(text) == want


REL = "relation_id long, relation_kind string, property_iri string, unit string, unit_iri string, val double, rationale string, extra string"
VAL = "locator string, property string, c0 double, c1 double, equation_form string, uncertainty string, extra string"
CAT = "property string, unit_curie string, unit_symbol string, decimals int"


def _run(spark, rel, val):
    cat = [("density", "unit:GM-PER-CentiM3", "g/cm3", 3), ("meltingPoint", "unit:K", "K", 1)]
    rows = to_common_units(spark.createDataFrame(rel, REL), spark.createDataFrame(val, VAL), spark.createDataFrame(cat, CAT)).collect()
    return {(r.src, r.rec_key): r.scaled_value for r in rows}


def test_records(spark):
    stated = [(100 + i, "measurement", "msr:density", "g/cm3", None, 1.6 + i * 0.03, None, "x") for i in range(100)]
    kg = [(300 + i, "measurement", "msr:density", "kg/m3", None, 1700.0 + i * 10, None, "x") for i in range(100)]
    rel = [
        (1, "measurement", "msr:density", "lb/ft3", None, 100.0, None, "x"), (1, "measurement", "msr:density", "lb/ft3", None, 100.0, None, "x"),
        (2, "measurement", "msr:density", "cP", None, 3.0, None, "x"), (3, "measurement", "msr:density", None, None, 2500.0, "density of 2,500 kg/m3 read from the text", "x"),
        (4, "measurement", "msr:density", "kg/m3", None, None, None, "x"), (5, "role", "msr:density", "kg/m3", None, 5.0, None, "x"), (6, "measurement", "msr:meltingPoint", "deg F", None, 1000.0, None, "x"),
        (7, "measurement", None, "kg/m3", None, 1.0, None, None), (8, "measurement", "msr:density", "kg/m3", None, float("nan"), None, None),
    ]
    val = [("a", "density", 3000.0, None, "point", "", None), ("b", "density", 3.0, None, "point", None, None), ("c", "density", 2.0, -0.001, "Linear; T in °C", "2 %", None), ("d", "density", float("inf"), None, "point in kg/m3", "", None), ("e", "density", 150.0, None, "point", "+/- 3 lb/ft3", None)]
    got = _run(spark, stated + kg + rel, val)
    own = {k: v for k, v in got.items() if k[0] == "measurement_value" or int(k[1]) < 100}
    assert own == {("relations", "1"): 1602, ("relations", "3"): 2500, ("relations", "6"): 8109, ("measurement_value", "a"): 3000, ("measurement_value", "c"): 2273, ("measurement_value", "e"): 2403}


def test_empty_tables(spark):
    assert _run(spark, [], []) == {}


def test_unit_expression_of_any_length():
    from saltmarsh.functions.units import find_unit, parse_unit

    long = "1.5 " + " ".join(["kg"] + ["m m-1"] * 40 + ["m-3"]) + " at the melting point"
    assert find_unit(long, parse_unit("kg/m3").dim) == parse_unit(" ".join(["kg"] + ["m m-1"] * 40 + ["m-3"]))
    assert find_unit("about 12 of them, 3.5 g per cubic cm, which is much", parse_unit("g/cm3").dim).scale == parse_unit("g/cm3").scale
