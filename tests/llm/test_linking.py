import pytest

from saltmarsh.llm.linking import Reference, distance, fit, link_novel

ROWS = [
    ("voc:pump", "pump bowl", [], "class"), ("voc:spump", "secondary pump bowl", [], "class"), ("voc:cond", "thermal conductivity", [], "concept"), ("voc:econd", "electrical conductivity", [], "concept"), ("voc:visc", "viscosity", ["internal friction"], "concept"),
    ("voc:tl", "Tallis loop", ["TL-54"], "concept"), ("voc:ogl", "off-gas line", [], "class"), ("s:1", "BeF2-LiF", [], "salt"), ("s:2", "BeF2-LiF-UF4", [], "salt"), ("s:3", "AlF3-BaF2", ["Brinolite"], "salt"), ("voc:cap", "heat capacity", [], "concept"),
]


@pytest.fixture(scope="module")
def ref():
    return Reference(ROWS, {"the", "its", "a", "measured", "melt", "mixture", "system"}, {"ht": "heat"}, 0.74)


@pytest.mark.parametrize("surface, iri", [
    ("Pump  Bowl.", "voc:pump"), ("its secundary pump bowls", "voc:spump"), ("conductivity, thermal", "voc:cond"), ("Thermal Cond.", "voc:cond"), ("eIectrical conductiv1ty", "voc:econd"), ("viscositiess", "voc:visc"), ("measurde viscosity", "voc:visc"),
    ("internal fricton", "voc:visc"), ("TL54", "voc:tl"), ("TL-55", "none"), ("LiF–BeF₂ melt", "s:1"), ("BEF2 + lif", "s:1"), ("LiF-UF4-BeF2", "s:2"), ("LiF-UF4", "none"), ("BeF, - LiF mixture", "s:1"), ("LlF·BeF2", "s:1"), ("UF3-BeF2-LiF", "none"),
    ("brinolite", "s:3"), ("ht. capacity", "voc:cap"), ("heat capacities", "voc:cap"), ("off-gs line", "voc:ogl"), ("pumpbowl", "voc:pump"), ("p. 359", "none"), ("shipping crate", "none"), ("-", "none"), ("1968", "none"), ("density of traffic", "none"),
    ("Dunnock loop", "none"), ("pump bowl ", "voc:pump"), ("x" * 5000, "none"),
])
def test_names(surface, iri, ref):
    assert ref.resolve(surface) == iri


def test_distance():
    assert distance("abcd", "abdc", 2) == 1 and distance("abc", "xyz", 2) == 3 and distance("", "ab", 2) == 2


def test_acceptance_is_fitted(ref):
    assert 0.4 <= fit(ref, [("pump bowl", "voc:pump"), ("fire drill", None), (None, None)]) < 1


def test_mentions(spark):
    m = [(1, "novel", "pump bowI", None), (1, "novel", "pump bowI", None), (2, "novel", None, None), (3, "novel", "  ", None), (4, "linked", "pump bowl", "voc:pump"), (5, "novel", "fire drill", None)]
    mentions = spark.createDataFrame(m, "mention_id long, status string, surface_form string, target_iri string")
    concepts = spark.createDataFrame(ROWS, "target_iri string, pref_label string, alt_labels array<string>, target_kind string")
    gold = spark.createDataFrame([(1, "pump bowl", "voc:pump"), (2, "fire drill", None)], "gold_id long, surface string, expected_target_iri string")
    assert sorted(tuple(r) for r in link_novel(mentions, concepts, gold).collect()) == [(1, "voc:pump"), (5, "none")]
    assert sorted(tuple(r) for r in link_novel(mentions, concepts.limit(0), gold).collect()) == [(1, "none"), (5, "none")]
    assert link_novel(mentions.limit(0), concepts, gold).count() == 0


def linked_by(spark, mentions, gold, **kw):
    """{mention_id: target_iri} of the mentions (status, surface, target), numbered from 1."""
    m = spark.createDataFrame([(k, *r) for k, r in enumerate(mentions, 1)], "mention_id long, status string, surface_form string, target_iri string")
    c = spark.createDataFrame(ROWS, "target_iri string, pref_label string, alt_labels array<string>, target_kind string")
    g = spark.createDataFrame([(k, *r) for k, r in enumerate(gold, 1)], "gold_id long, surface string, expected_target_iri string")
    return {r["mention_id"]: r["target_iri"] for r in link_novel(m, c, g, **kw).collect()}


def test_acceptance_is_fitted_on_all_labelled_rows(spark):
    asked = [("novel", "pump bowl spare", None), ("novel", "pump bowl", None)]
    right, wrong = [("pump bowl spare", "voc:pump")] * 5000, [("pump bowl spare", None)] * 5500
    assert linked_by(spark, asked, right) == {1: "voc:pump", 2: "voc:pump"}
    assert linked_by(spark, asked, right + wrong) == linked_by(spark, asked, wrong + right) == {1: "none", 2: "voc:pump"}


@pytest.mark.parametrize("most_sent", [5000, 0])
def test_rare_words_are_learnt(most_sent, spark):
    linked = [("linked", "the viscosity", "voc:visc")] * 20000 + [("linked", "the pump bowl", "voc:pump")] * 20000 + [("linked", "the off-gas line", "voc:ogl")]
    linked += [("linked", "hq capacity", "voc:cap")] * 3 + [("linked", "spare viscosity", "voc:visc"), ("linked", "spare pump bowl", "voc:pump"), ("linked", "off-gas line spare", "voc:ogl")]
    asked = ["hq. capacity", "spare viscosity", "spares viscosity", "the spqre pump bowl", "tallis loop spare", "other viscosity", "spare", "LiF-BeF2 spare", None]
    got = linked_by(spark, [("novel", s, None) for s in asked] + linked, [("pump bowl", "voc:pump"), ("secondary bowl", None)], most_sent=most_sent)
    assert [got.get(k) for k in range(1, 10)] == ["voc:cap", "voc:visc", "voc:visc", "voc:pump", "voc:tl", "none", "none", "s:1", None]


def test_acceptance_of_counts(ref):
    gold = [("pump bowl", "voc:pump"), ("pump bowl spare", None), ("secondary bowl", "voc:spump"), ("loop tallis north", "voc:tl"), ("fire drill", None)]
    assert fit(ref, gold) == 0.77 and fit(ref, []) == ref.accept
