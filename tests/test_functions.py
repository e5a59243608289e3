import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import chem, equations, numbers, text


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    got = row.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return got[0] if len(cols) == 1 else tuple(got)


@pytest.mark.parametrize("salt, composition, code, canonical, iri, reason", [
    ("BeF2-LiF", "34.0-66.0", "P1", "BeF2-LiF | 34.0-66.0", "msrd:salt-BeF2-LiF-34.0-66.0", None),
    ("LiF-BeF2", "34.0-66.0", "P1", "BeF2-LiF | 66.0-34.0", "msrd:salt-BeF2-LiF-66.0-34.0", None),
    ("KF-LiF-NaF", "42.0-46.5-11.5", "P1", "KF-LiF-NaF | 42.0-46.5-11.5", "msrd:salt-KF-LiF-NaF-42.0-46.5-11.5", None),
    ("LiF-NaF-KF", "46.5-11.5-42.0", "P1", "KF-LiF-NaF | 42.0-46.5-11.5", "msrd:salt-KF-LiF-NaF-42.0-46.5-11.5", None),
    ("LiF", "100", "P1", "LiF | 100.0", "msrd:salt-LiF-100.0", None),
    ("KF-ZrF4", "0.0-33.3 ZrF4", "I3", "KF-ZrF4 | ZrF4 0.0-33.3", "msrd:salt-KF-ZrF4-ZrF4-0.0-33.3", None),
    ("LiF-NaF", "34.25-65.75", "P1", "LiF-NaF | 34.2-65.8", "msrd:salt-LiF-NaF-34.2-65.8", None),
    ("LiF-NaF", "50-30", "P1", None, None, "sum"), ("LiF-NaF", "100", "P1", None, None, "value-count"), ("LiF--NaF", "1-2-97", "P1", None, None, "empty-component"),
    ("LiF-NaF-KF", "0-10 KF", "I1", None, None, "range-components"), ("LiF-NaF", "0-10 KF", "I1", None, None, "range-component"), ("LiF-NaF", "0-10", "I1", None, None, "range-form"),
    ("LiF-NaF", "a-b", "P1", None, None, "value"), (None, None, "P1", None, None, "empty-component"),
])
def test_canonical(spark, salt, composition, code, canonical, iri, reason):
    r = chem.canonical_salts(spark.createDataFrame([(salt, composition, code)], "raw_salt string, raw_composition string, form_code string")).first()
    assert (r.canonical, r.iri, r.flag_reason) == (canonical, iri, reason)


def test_constituents(spark):
    rows = spark.createDataFrame([("LiF-NaF", "26.04-72.96", "P1"), ("KF-ZrF4", "0.0-33.3 ZrF4", "I3")], "raw_salt string, raw_composition string, form_code string")
    a, b = chem.canonical_salts(rows).collect()
    assert [c.mole_fraction for c in a.constituents] == pytest.approx([0.26, 0.73])
    assert [(c.compound, c.mf_min, c.mf_max) for c in b.constituents] == [("KF", pytest.approx(0.667), 1.0), ("ZrF4", 0.0, pytest.approx(0.333))]


@pytest.mark.parametrize("surface, salt", [
    ("LiF·BeF₂ (66-34 mol%)", "msrd:salt-BeF2-LiF-34.0-66.0"), ("2LiF - BeF2 66-34 mole %", "msrd:salt-BeF2-LiF-34.0-66.0"), ("LiF-BeF2", None), ("LiF-BeF2 (1-2-97 mol%)", None),
    ("LiF-BeF, (66-34 mole %)", "msrd:salt-BeF2-LiF-34.0-66.0"), ("LiF-XyF, (66-34 mol%)", None),
])
def test_composed(spark, surface, salt):
    known = chem.unique_skeletons(spark.createDataFrame([("LiF",), ("BeF2",), ("UF3",), ("UF4",)], "compound string"))
    assert chem.composed_salts(spark.createDataFrame([(surface,)], "surface string"), known=known).first().salt_iri == salt


def test_variants(spark):
    got = one(spark, chem.label_variants(F.col("x")), x="LiF-BeF2")
    assert {"LiF-BeF2", "LiF BeF2", "LiFBeF2", "lif-bef,", "LiF BeF.", "lifbef2"} <= set(got) and got == sorted(got)
    assert one(spark, chem.label_variants(F.col("x")), x="viscosity") == ["viscosity"]
    assert one(spark, chem.label_variants(F.col("x")), x="  ") == []


@pytest.mark.parametrize("raw, clean", [
    ("prop-\nerties", "properties"), ("LiF-\nBeF2", "LiF-BeF2"), ("cm⁻³", "cm-3"), ("²³⁵U", "235U"), ("ﬁle", "file"), ("η = 0.084·exp(4340/T)", "η = 0.084·exp(4340/T)"),
    ("a  b\t c \n\n\n\nd\ne", "a b c\n\nd e"), ("CORRO SION", "CORROSION"), (None, None),
])
def test_normalise(spark, raw, clean):
    assert one(spark, text.normalise_ocr(F.col("x")), x=raw) == clean


def test_tokens_and_ngrams(spark):
    got = one(spark, text.tokens(F.col("x")), x="The off-gas of UF4 was the Salt's and is OK")
    assert got == ["off-gas", "salt's"]
    assert one(spark, text.tokens(F.col("x")), x=None) == []
    df = spark.createDataFrame([(["a", "b", "a"],), ([],)], "w array<string>").select(text.ngrams(F.col("w")).alias("g"))
    assert [r.g for r in df.collect()] == [["a", "b", "a", "a b", "b a", "a b a"], []]


def test_sequences(spark):
    assert one(spark, text.camel_sequence(F.col("x")), x="MSRSalt moltenSalt_x") == ["msr", "salt", "molten", "salt", "x"]
    assert one(spark, text.salt_sequence(F.col("x")), x="LiF-BeF2 (34.0-66.0 mol%)") == ["lif", "bef2"]


@pytest.mark.parametrize("old, new", [("0.4.0", "0.5.0"), ("0.4.0-seed", "0.5.0"), ("1.2.9", "1.3.0"), ("0.4", "0.5.0"), ("x", None)])
def test_bump(spark, old, new):
    assert one(spark, text.bump_minor(F.col("x")), x=old) == new


def test_small_texts(spark):
    assert one(spark, text.term_slug(F.col("x")), x=" Heat Transfer! ") == "heat-transfer"
    assert one(spark, chem.slug(F.col("x")), x="a | b=c@d/") == "a-b-c-d"
    assert one(spark, text.percent_encoded(F.col("x")), x="a b/é") == "a%20b%2F%C3%A9"
    assert one(spark, text.without_thinking(F.col("x")), x="a<THINK>b</think> c<think>d\n") == "a c"
    assert one(spark, text.companion_relation(F.col("x")), x="Moderator") == "moderatedBy"
    assert one(spark, text.expand(F.col("x"), {"msrd": "http://x#"}), x="msrd:a") == "http://x#a"


def test_numbers(spark):
    assert [one(spark, numbers.fixed1(F.col("x")), x=v) for v in (34.25, 0.15, 2.0)] == ["34.2", "0.1", "2.0"]
    assert [one(spark, numbers.shortest(F.col("x")), x=v) for v in (800.0, 1e-4, 1e22, 2.5)] == ["800.0", "0.0001", "10000000000000000000000.0", "2.5"]
    assert [one(spark, numbers.lenient(F.col("x"), True), x=v) for v in ("900K", " 5e2 k", "", "5d", "0x1p3", None)] == [900.0, 500.0, None, None, None, None]
    assert [one(spark, numbers.confidence(F.col("x")), x=v) for v in (0.5, 1.5, float("nan"), -1.0)] == [0.5, 0.0, 0.0, 0.0]


def test_equations(spark):
    at = lambda form, c, x: one(spark, equations.value_at(F.lit(form), [F.lit(v) for v in (c + [0.0] * 5)[:5]], F.lit(x)), x="")
    assert at("Linear", [2.413, -4.88e-4], 900.0) == pytest.approx(1.9738)
    assert at("Arrhenius", [0.084, 36000.0], 900.0) == pytest.approx(0.084 * 2.718281828 ** (36000 / (8.31441 * 900)), rel=1e-6)
    assert at("DiscretePoint", [2.0, 600.0], 600.0) == 2.0 and at("DiscretePoint", [2.0, 600.0], 601.0) is None and at("none", [1.0], 1.0) is None
    g = lambda x: tuple(one(spark, equations.gated(F.lit(1.5), F.lit(x), F.lit(800.0), F.lit(1080.0)), x=""))
    assert g(900.0) == (1.5, "ok") and g(1500.0) == (None, "out-of-range")


@pytest.mark.parametrize("hint, c, v, t, lo, hi, want", [
    ("Linear", [1.0, 2.0], None, None, 900.0, 500.0, ("Linear", [1.0, 2.0], 500.0, 900.0)), ("linear", [1.0], None, None, None, None, None), ("poly2", [1.0, 2.0, 3.0], None, None, 1.0, None, ("Polynomial2", [1.0, 2.0, 3.0], None, None)),
    ("discrete", None, 2.28, 600.0, None, None, ("DiscretePoint", [2.28, 600.0], 600.0, 600.0)), ("point", None, 2.28, None, None, None, None), (None, [1.0, 2.0], None, None, None, None, None),
])
def test_correlation(spark, hint, c, v, t, lo, hi, want):
    df = spark.createDataFrame([(hint, c, v, t, lo, hi)], "h string, c array<double>, v double, t double, lo double, hi double")
    got = df.select(equations.parse_correlation(*map(F.col, ("h", "c", "v", "t", "lo", "hi"))).alias("r")).first().r
    assert (tuple(got) if got else None) == want


def test_unknown_code_stops_the_run(spark):
    with pytest.raises(Exception, match="unknown equation form"):
        one(spark, equations.form_of_code(F.col("x")), x="ZZ")


def test_surface_forms_are_the_label_variants(spark):
    labels = ["LiF-BeF2", "UF4", "viscosity", "  ", "", " drain  tank ", "LiF·ThF4", "off-gas", "MgF2-UF4-KF", "LiF", "BeF2 • NaF", "5-UF4", "Na2UF6"]
    rows = spark.createDataFrame([(x,) for x in labels], "x string").select("x", chem.label_variants(F.col("x")).alias("v")).collect()
    assert {r.x: r.v for r in rows} == {x: chem.surface_forms(x) for x in labels}


def brute_reason(salt, comp, code):
    parts, comp = (salt or "").strip().split("-"), (comp or "").strip()
    fields, ranged = comp.split(), code in ("I1", "I2", "I3", "I4")
    raw = [v.strip() for v in (fields[0] if fields and ranged else comp).split("-")]
    if any(not p.strip() for p in parts):
        return "empty-component"
    if ranged and len(parts) != 2:
        return "range-components"
    if ranged and (len(fields) != 2 or len(raw) != 2):
        return "range-form"
    if not ranged and len(raw) != len(parts):
        return "value-count"
    if not all(re.fullmatch(r"\d+(\.\d+)?", v) for v in raw):
        return "value"
    if ranged:
        return None if fields[1] in parts else "range-component"
    return None if abs(sum(map(float, raw)) - 100) <= 2 else "sum"


def test_all_salts_have_a_form_or_a_reason(spark, tmp_path):
    from saltmarsh.plans.catalogue import QUERIES

    rows = [
        ("LiF-BeF2", "66-34", "P1"), ("LiF-BeF2", " 66 - 34 ", None), ("LiF-BeF2", "66-33-1", None), ("LiF-", "66-34", "P1"), (None, "100", "P1"), ("UF4", None, "P1"), ("UF4", "", "P1"), ("LiF, BeF2", "66, 34", "P1"),
        ("LiF-BeF2", "60-30", "P1"), ("LiF-BeF2", "66%-34%", "P1"), ("LiF-BeF2", "10-20 LiF", "I1"), ("LiF-BeF2", "10-20 KF", "I2"), ("LiF", "10-20 LiF", "I3"), ("LiF-BeF2", "10 to 20 LiF", "I4"), ("LiF-BeF2", "x-20 LiF", "I1"),
    ]
    cases = [(i, "nist" if i % 2 else "document", *r) for i, r in enumerate(rows)]
    spark.createDataFrame(cases, "case_id long, source string, raw_salt string, raw_composition string, form_code string").write.parquet(f"{tmp_path}/salt_canonicalization.parquet")
    spark.createDataFrame([("UF4", "document"), (None, "nist")], "salt string, source string").write.parquet(f"{tmp_path}/measurement_value.parquet")
    want = {i: brute_reason(*r) for i, r in enumerate(rows)}
    got = {r.case_id: r for r in QUERIES["canonicalize_lockstep"](spark, str(tmp_path)).collect()}
    assert {i: r.flag_reason for i, r in got.items()} == want and set(want.values()) >= {"empty-component", "value", "value-count", "sum", "range-form", None}
    assert all((r.canonical is None) == (r.flag_reason is not None) for r in got.values()) and got[0].canonical == "BeF2-LiF | 34.0-66.0"
    counted = Counter((s, want[i]) for i, s, *_ in cases)
    assert {(r.source, r.flag_reason): r.cases for r in QUERIES["positional_tolerance_flag"](spark, str(tmp_path)).collect()} == counted
    assert {r.label: r.variants for r in QUERIES["label_variants"](spark, str(tmp_path)).collect()} == {s: chem.surface_forms(s) for s, *_ in rows if s}


def test_thinking_of_whole_texts(spark, tmp_path):
    from saltmarsh.plans.catalogue import QUERIES

    long = "a line\nof text " * 9
    spark.createDataFrame([(1, long), (2, "x</think> y <think>z"), (3, long), (4, None), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.answer, r.thoughts) for r in QUERIES["think_split"](spark, str(tmp_path)).collect()}
    assert got == {1: ("Before  after 1", [long]), 2: ("Before  y  after 2", ["x", "z"]), 3: ("Before", [long]), 5: ("Before  after 5", [""])}


@pytest.mark.parametrize("name, relation", [("Moderator", "moderatedBy"), ("Heater", "heatedBy"), ("Salt", "saltedBy"), ("", ""), (None, None)])
def test_companion_relation(spark, name, relation):
    assert one(spark, text.companion_relation(F.col("x")), x=name) == relation


@pytest.mark.parametrize("raw, coded", [("a b/é", "a%20b%2F%C3%A9"), ("~*+-_.", "~%2A%2B-_."), ("%7E", "%257E"), ("", "")])
def test_percent_encoding(spark, raw, coded):
    assert one(spark, text.percent_encoded(F.col("x")), x=raw) == coded


@pytest.mark.parametrize("x, both", [
    ("the solubility is 3.4 mol % here", (True, False)), ("12 g/L of it, the Solubilities", (True, False)), ("solubility of salt", (False, False)), ("graphite as the moderator", (False, True)), ("moderation by graphite", (False, False)), ("moderated by graphite", (False, True)),
])
def test_evolution_targets(spark, x, both):
    assert tuple(one(spark, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(text.evolution_targets(F.col("x")))]), x=x)) == both


@pytest.mark.parametrize("name, iri", [("IAEA SSR-2/1", "msrd:iaea-ssr-2-1"), ("<>;", None), ("", None), ("A  b", "msrd:a-b")])
def test_standard_iri(spark, name, iri):
    assert one(spark, text.standard_iri(F.col("x")), x=name) == iri


def test_reactor_and_trailing(spark):
    assert one(spark, text.reactor_iri(F.col("x")), x="--MSRE {1}--") == "msrd:reactor-msre1"
    assert one(spark, text.trailing(F.split("x", " "), 3), x="a b c d e") == ["c", "d", "e"] and one(spark, text.trailing(F.split("x", " "), 3), x="a b") == ["a", "b"]


@pytest.mark.parametrize("t, spans", [
    ("the LiF-BeF2 melt", ["LiF-BeF2"]), ("LiF · BeF₂ (66-34 mol%) was", ["LiF · BeF₂ (66-34 mol%)"]), ("2LiF-BeF2, and", ["2LiF-BeF2,"]), ("LiF alone", []), ("", []), ("LiF-", []), ("a 1-2 mol% b", []), ("LiF-BeF2-ThF4 65-25-10 mol. e. %", ["LiF-BeF2-ThF4 65-25-10 mol. e. %"]),
])
def test_formula_spans(t, spans):
    from saltmarsh.functions import formula

    assert [s.surface for s in formula.salts(t)] == spans
