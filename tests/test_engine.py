import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import graph, grounding, ingest, linker, mining, relations, review, shapes, sqlsurface
from saltmarsh.sources import tabular, turtle
from saltmarsh.sources.store import SnapshotStore, cached_decisions, known_hash, upsert
from saltmarsh.streaming import observations

TTL = """@prefix skos: <http://s#> .
voc:a a skos:Concept ; skos:prefLabel "A \\"x\\""@en , "B" ; skos:broader voc:b . # note
voc:b a skos:Concept ; msr:n 5 ; msr:d 800.0 ; msr:t true .
"""


def test_turtle(spark):
    q = turtle.turtle_quads(spark, TTL, "vocab")
    rows = {(r.s, r.p, r.o, r.o_type, r.datatype, r.lang) for r in q.collect()}
    assert ("voc:a", "skos:prefLabel", 'A "x"', "literal", None, "en") in rows and ("voc:b", "msr:d", "800.0", "literal", "xsd:decimal", None) in rows and len(rows) == 8
    assert turtle.n_quads(q.where("o = 'A \"x\"'")).first().value == '<voc:a> <skos:prefLabel> "A \\"x\\""@en <vocab> .'
    with pytest.raises(ValueError):
        turtle.parse("voc:a ( 1 2 ) .")


def _quads(spark, rows):
    return spark.createDataFrame([(g, s, p, o, "uri" if ":" in o else "literal", None, None) for g, s, p, o in rows], turtle.QUAD)


def test_core_and_sets(spark):
    q = _quads(spark, [("data", "a:1", "p:x", "b:1"), ("vocab", "a:1", "p:x", "b:1"), ("staging", "a:2", "p:x", "1")])
    assert graph.core(q).count() == 1
    assert graph.insert(q, q).count() == 3
    assert graph.remove(q, q.where("g = 'data'")).count() == 2
    assert {r.g: r.triples for r in graph.graph_counts(graph.put(q, q.where("g = 'data'"), "staging")).collect()} == {"data": 1, "vocab": 1, "staging": 1}
    with pytest.raises(ValueError):
        graph.put(q, q, "elsewhere")
    new = graph.replace_value(q, "staging", spark.createDataFrame([("a:2",)], "s string"), "p:x", "2")
    assert new.where("g = 'staging'").first().o == "2" and new.count() == 3
    assert graph.delete_where(q, F.col("p") == "p:x").count() == 0


def test_closure_is_reflexive_and_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = graph.closure(e, spark.createDataFrame([("a",), ("z",)], "node string"))
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("z", "z")}
    assert {tuple(r) for r in graph.closure(e, spark.createDataFrame([("z",)], "node string"), reflexive=False).collect()} == set()


def test_routing_overlaps(spark):
    q = _quads(spark, [("p", "c:1", "rdf:type", "skos:Concept"), ("p", "c:1", "rdf:type", "owl:Class"), ("p", "i:1", "rdf:type", "c:1"), ("p", "i:1", "skos:note", "x")])
    got = {(r.g, r.s, r.p) for r in graph.routed(q).collect()}
    assert got == {("vocab", "c:1", "rdf:type"), ("ontology", "c:1", "rdf:type"), ("data", "i:1", "rdf:type"), ("vocab", "i:1", "skos:note")}


def _measurement(lo="800.0", hi="1080.0", unit="unit:X"):
    m = "m:1"
    return [("data", m, "rdf:type", "msr:PropertyMeasurement"), ("data", m, "prov:wasDerivedFrom", "d:1"), ("data", m, "prov:wasGeneratedBy", "r:1"), ("data", m, "msr:dataLocator", "loc"), ("data", m, "msr:forProperty", "msr:density"), ("data", m, "msr:ofSalt", "s:1"), ("data", m, "msr:hasUnit", unit), ("data", m, "msr:equationForm", "msr:Linear")] + [("data", m, p, v) for p, v in (("msr:validTempMin", lo), ("msr:validTempMax", hi)) if v]


@pytest.mark.parametrize("rows, shape", [
    (_measurement(), None), (_measurement(lo=None), "ValidTemperatureRangeShape"), (_measurement("900", "800"), "ValidTemperatureRangeShape"), (_measurement()[:3] + _measurement()[4:], "PropertyMeasurementShape"),
    (_measurement(unit="unit:Y"), "PropertyMeasurementUnitAllowlistShape"), ([("data", "x:1", "msr:linksTo", "y:1")], "LinksToTargetKindShape"), ([("data", "x:1", "msr:linksTo", "y:1"), ("vocab", "y:1", "rdf:type", "skos:Concept")], None),
    ([("data", "f:1", "msr:servedByProperty", "y:1")], "ServedByPropertyTargetShape"), ([("data", "f:1", "rdf:type", "msr:SafetyFunction")], "SafetyIndividualProvenanceShape"), ([("staging", "x:1", "msr:linksTo", "y:1")], None),
])
def test_shapes(spark, rows, shape):
    got = {r.shape for r in shapes.validate(_quads(spark, rows), spark.createDataFrame([("unit:X",)], "unit string")).collect()}
    assert got == ({shape} if shape else set())


def test_store(spark, tmp_path):
    st = SnapshotStore(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    st.write({"t": a})
    st.checkpoint("one", "0.4.0")
    st.write({"t": upsert(st.read("t"), spark.createDataFrame([(2, "c", 1), (2, "d", 2), (None, "x", 1)], "k int, v string, n int"), "k", "n")})
    assert {tuple(r) for r in st.read("t").collect()} == {(1, "a"), (2, "d")}
    with pytest.raises(FileExistsError):
        st.checkpoint("one")
    st.restore("one")
    assert {tuple(r) for r in st.read("t").collect()} == {(1, "a"), (2, "b")}
    assert st.checkpoints() == [{"label": "one", "version": "0.4.0"}]
    with pytest.raises(ValueError):
        st.restore("../x")
    bad = _quads(spark, [("data", "x:1", "msr:linksTo", "y:1")])
    with pytest.raises(shapes.Rejected):
        shapes.commit(st, "quads", bad)
    assert st.read("quads") is None


def test_cache(spark):
    iris = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "iri string")
    h = known_hash(iris).first().hash
    assert h == known_hash(iris.orderBy(F.desc("iri"))).first().hash != known_hash(iris.where("iri = 'a'")).first().hash
    cache = spark.createDataFrame([("x", h, "linked", "a"), ("y", "old", "linked", "b")], "surface string, hash string, status string, target_iri string")
    done, todo = cached_decisions(spark.createDataFrame([("x",), ("y",), (None,)], "surface string"), cache, h)
    assert [r.surface for r in done.collect()] == ["x"] and [r.surface for r in todo.collect()] == ["y"]


CSV = '''Title

Salt,Composition range,Data type,T min (K),T max (K),Uncertainty,Data 1,Data 2,Data 3,Data 4,Data 5,Comment,Formatting comment
BeF2-LiF,34.0-66.0,P1,800,1080,,2.413,-4.88E-4,,,,"a, ""b""
c",
LiF-BeF2,66.0-34.0,DP,,,2%,2.0,900K,,,,,
BeF2,100,DP,,,,1.0,900K,,,,,
BeF2,100,DP,,,,1.1,900K,,,,,
BeF2,100,+E,700,,,1.2,3,,,,,
NaCl-KF,50-50,P1,1,2,,1,2,,,,,
LiF-NaF,50-30,P1,1,2,,1,2,,,,,
KF-ZrF4,0.0-33.3 ZrF4,I3,1000,,,1,2,3,4,,,
too,short
'''


def test_property_table_to_answer(spark, tmp_path):
    (tmp_path / "density.txt").write_text(CSV)
    raw = tabular.property_rows(spark, {"density": str(tmp_path / "density.txt")})
    assert raw.count() == 8
    rows = ingest.measured(raw, {"density": "unit:GM-PER-CentiM3"})
    s = ingest.summary(rows).first()
    assert (s.read, s.kept, s.out_of_scope, s.flagged, s.distinct_salts) == (8, 6, 1, 1, 3)
    k = ingest.kept(rows)
    locs = sorted(r.locator for r in k.collect())
    base = "nist-srd27/density#"
    assert locs == sorted([f"{base}BeF2-LiF|34.0-66.0@800", f"{base}BeF2-LiF|34.0-66.0@900", f"{base}BeF2|100.0@700", f"{base}BeF2|100.0@900", f"{base}BeF2|100.0@900-3", f"{base}KF-ZrF4|ZrF4=0.0-33.3"])
    values = ingest.value_rows(k)
    own = k.where("form = 'Linear'").select("locator")
    at = lambda t: grounding.evaluate(own, values, t).first()
    assert at(900).value == pytest.approx(1.9738) and at(1500).status == "out-of-range" and at(1500).value is None
    q = ingest.catalog_quads(k)
    assert graph.insert(q, q).count() == q.count() and q.where("s like 'msrd:salt-KF-ZrF4%-c-KF' and p = 'msr:moleFractionMin'").first().o == "0.667"


def test_corpus_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "r 1.txt").write_text("hello\nworld")
    (tmp_path / "c" / "x.md").write_text("no")
    assert [tuple(r) for r in tabular.text_corpus(spark, str(tmp_path / "c")).collect()] == [("r 1", "hello\nworld")]
    (tmp_path / "m.md").write_text("| Title | Report | Date | OCR |\n|---|---|---|---|\n| A | R-1 | 1960 | [t](ocr/R-1.txt) |\n| B | R-2 | 1961 | none |\n| three | cells | only |\n")
    assert [tuple(r) for r in tabular.manifest(spark, str(tmp_path / "m.md")).collect()] == [("R-1", "A", "1960", "ocr/R-1.txt")]
    pages = spark.createDataFrame([("d", i, f"p{i}") for i in range(1, 6)], "document string, page int, text string")
    ranges = spark.createDataFrame([("d", 2, 3), ("d", 3, 3), ("d", 5, 9)], "document string, start int, end int")
    assert tabular.page_text(pages, ranges).first().text == "p2\n\np3\n\np5"
    e = spark.createDataFrame([("event: tool\ndata: {\"a\":\ndata: 1}\n\n: note\n\ndata: x\n\n",)], "t string").select(tabular.sse_events(F.col("t")).alias("e")).first().e
    assert [tuple(x) for x in e] == [("tool", '{"a":\n1}'), ("message", "x")]


def test_queue(spark):
    p = spark.createDataFrame([("1", "class", "pending", "salt"), ("2", "class", "approved", "pump")], "proposal_id string, kind string, status string, term string")
    o = spark.createDataFrame([("1", "d1", 4, "chem", "T1"), ("1", "d2", 2, "safety", "T1"), ("1", "d2", 5, "safety", "T2"), ("1", None, 9, "chem", "T3")], "proposal_id string, document string, occurrence_count int, corpus string, generated_at string")
    rows = {r.proposal_id: r for r in review.queue(p, o).collect()}
    assert (rows["1"].document_frequency, rows["1"].total_occurrences, rows["1"].corpus_count, rows["1"].corpora) == (2, 9, 2, ["chem", "safety"])
    assert (rows["2"].document_frequency, rows["2"].total_occurrences, rows["2"].corpora) == (0, 0, [])
    assert [r.proposal_id for r in review.queue(p, o, "approved").collect()] == ["2"]
    d = review.nested_breakdown(o).first().corpora
    assert [(c.corpus, [(x.document, x.occurrence_count, x.first_observed, x.last_observed) for x in c.documents]) for c in d] == [("chem", [("d1", 4, "T1", "T1")]), ("safety", [("d2", 5, "T1", "T2")])]


def test_mining(spark):
    docs = spark.createDataFrame([(1, "Molten salt and graphite moderator", "a"), (2, "molten salt in graphite", "b"), (3, None, None), (4, "", "c")], "doc_id int, text string, corpus string")
    df = {r.term: r.doc_frequency for r in mining.document_frequency(docs).collect()}
    assert df["molten salt"] == 2 and df["graphite"] == 2 and df["graphite moderator"] == 1
    known = mining.exclusion_keys(spark.createDataFrame([("MoltenSalt", "class"), ("LiF-BeF2 (34-66 mol%)", "salt")], "label string, kind string"), spark.createDataFrame([("Graphite",)], "surface_form string"))
    left = {r.term for r in mining.mine(docs, known, floor=1, ceiling=None).collect()}
    assert "salt" in left and "moderator" in left and not any("graphite" in t or "molten salt" in t for t in left)
    top = mining.mine(docs, floor=2, ceiling=2).collect()
    assert {r.term for r in top} == {"graphite", "molten"} and all(r.total_occurrences == 2 for r in top)
    wanted = spark.createDataFrame([("salt",), ("nowhere",)], "term string")
    assert {r.term: r.doc_frequency for r in mining.document_frequency(docs, terms=wanted).collect()} == {"salt": 2, "nowhere": 0}
    assert {(r.document, r.corpus, r.occurrence_count) for r in mining.observations(docs, wanted).collect()} == {(1, "a", 1), (2, "b", 1)}
    assert mining.document_frequency(docs.where("doc_id > 9")).count() == 0


def test_linker(spark):
    known = spark.createDataFrame([("voc:flibe", "concept", ["LiF-BeF2", "FLiBe"]), ("msrd:salt-BeF2-LiF-34.0-66.0", "salt", ["BeF2-LiF (34-66)"]), ("voc:lif", "concept", ["LiF"]), ("voc:bef2", "concept", ["BeF2"]), ("voc:v", "concept", ["viscosity"])], "iri string, kind string, labels array<string>")
    seg = spark.createDataFrame([("r", 0, 100, "The Viscosity of LiF-BeF2 (66-34 mol%) and of LiF-BeF2 melts; NaF-XyF9 too."), ("r", 1, 0, None), ("r", 2, 0, "")], "report string, seg_index int, char_start int, text string")
    rows = {r.surface_form: r for r in linker.link_segments(seg, known).collect()}
    assert rows["Viscosity"].target_iri == "voc:v" and rows["Viscosity"].layer == 2 and rows["Viscosity"].char_start == 104
    assert rows["LiF-BeF2 (66-34 mol%)"].target_iri == "msrd:salt-BeF2-LiF-34.0-66.0" and rows["LiF-BeF2 (66-34 mol%)"].layer == 3
    assert rows["LiF-BeF2"].target_iri == "voc:flibe" and rows["NaF-XyF9"].status == "novel"
    assert linker.weighted_ratio("LiF-BeF2", "LiF-BeF2") == 100 and linker.weighted_ratio("a b", "b a") == 95


def test_linker_query_links_scanned_pages_and_variants(spark, tmp_path):
    from saltmarsh.plans.catalogue import QUERIES

    spark.createDataFrame([("voc:flibe", "concept", "LiF-BeF2", None), ("voc:uf4", "concept", "UF4", ["green salt"])], "target_iri string, target_kind string, pref_label string, alt_labels array<string>").write.parquet(f"{tmp_path}/concepts.parquet")
    seg = [("r", 0, 0, "para", "The LiF BeF2 melt."), ("r", 1, 50, "page", "MSX 12\nof LiFBeF, and UF, or UF4.")]
    spark.createDataFrame(seg, "report string, seg_index int, char_start int, layout string, text string").write.parquet(f"{tmp_path}/segments.parquet")
    got = {(r.seg_index, r.surface_form): (r.target_iri, r.layer) for r in QUERIES["layered_linker"](spark, str(tmp_path)).collect()}
    assert got == {(0, "LiF BeF2"): ("voc:flibe", 2), (1, "LiFBeF,"): ("voc:flibe", 2), (1, "UF,"): ("voc:uf4", 2), (1, "UF4"): ("voc:uf4", 2)}


def test_overlap_matches_all_pairs(spark):
    import random

    random.seed(3)
    spans = lambda n: [(i, random.randint(0, 2), s := random.randint(0, 900), s + random.randint(0, 600)) for i in range(n)]
    a, b = spans(80), spans(80)
    x, y = spark.createDataFrame(a, "a_id int, k int, char_start int, char_end int"), spark.createDataFrame(b, "id int, k int, char_start int, char_end int")
    want = sorted((i, j) for i, k, s, e in a for j, m, t, u in b if k == m and s < u and t < e)
    assert sorted((r.a_id, r.b_id) for r in linker.overlapping(x, y, ["k"]).collect()) == want
    free = {r.a_id for r in linker.overlapping(x, y, ["k"], "left_anti").collect()}
    assert free == {i for i, *_ in a} - {i for i, _ in want}


def test_relations(spark):
    reply = '{"relations": [{"kind": "measurement", "salt": "s:1", "property": "msr:density", "unit": "g/cm³", "confidence": 0.9, "form_hint": "linear", "coefficients": [1, 2]}, {"kind": "role", "salt": "s:1", "role": "r:9", "confidence": 0.8}, {"kind": "reactor", "salt": "s:1", "reactor": "x:1", "confidence": 0.7}, {"kind": "measurement", "salt": "s:1", "property": "msr:density", "unit": "cP", "confidence": 0.9}, {"kind": "role", "confidence": 0.2}]}'
    p = relations.proposals(spark.createDataFrame([("rep", 1, 0, reply), ("rep", 2, 5, "no json")], "report string, seg_index int, char_start int, reply string"))
    assert p.count() == 6 and p.where("malformed").count() == 1
    iri = lambda *x: spark.createDataFrame([(i,) for i in x], "iri string")
    known = {"salts": iri("s:1"), "properties": iri("msr:density"), "roles": iri("r:1"), "reactors": iri("x:1")}
    got = relations.validated(p.where("not malformed"), known, 0.5, spark.createDataFrame([("rep", 1, "x:1")], "report string, seg_index int, target_iri string"))
    assert sorted((r.kind, r.disposition, r.reason, r.unit_iri) for r in got.collect()) == sorted([
        ("measurement", "written", "", "unit:GM-PER-CentiM3"), ("role", "rejected", "unknown-role", None), ("reactor", "written", "", None), ("measurement", "rejected", "unit-dimension-mismatch", None), ("role", "skipped", "below-threshold", None),
    ])
    assert relations.edges(got).count() == 1


@pytest.mark.parametrize("query, ok", [
    ("SELECT 1", True), ("select a from t;", True), ("WITH x AS (SELECT 1) SELECT * FROM x", True), ("SELECT 'DROP;'", True), ("SELECT [drop] FROM t -- DELETE", True), ("SELECT 1; DROP TABLE t", False),
    ("SELECT '/*' ; DROP TABLE t ; SELECT '*/'", False), ("PRAGMA x", False), ("SELECT 'a", False), ("INSERT INTO t VALUES (1)", False), ("", False), ("/* x", False), ("WITH x AS (DELETE FROM t) SELECT 1", False), ("SELECT replace(a, 'b', 'c') FROM t", False),
])
def test_sql_guard(query, ok):
    assert sqlsurface.allowed(query) is ok


def test_sql_surface_sees_its_views_only(spark):
    v = spark.createDataFrame([(1,)], "a int")
    assert sqlsurface.select(spark, "WITH b AS (SELECT a FROM t) SELECT a + 1 AS x FROM b;", {"t": v}).first().x == 2
    v.createOrReplaceTempView("hidden")
    with pytest.raises(sqlsurface.Refused):
        sqlsurface.select(spark, "SELECT * FROM hidden", {"t": v})


def test_locators_in_scripts(spark):
    s = spark.createDataFrame([(1, "x = get('base@900')"), (2, "get('base')")], "script_id int, script string")
    assert [tuple(r) for r in grounding.referenced_locators(s, spark.createDataFrame([("base",)], "locator string")).collect()] == [(2, "base")]


def test_stream_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    rows.write.parquet(src)
    st = SnapshotStore(spark, str(tmp_path / "st"))
    for check in ("c1", "c2"):  # a second checkpoint delivers everything again
        observations.run_available(observations.event_stream(spark, src, rows.schema), observations.latest_sink(st, "t", ["k"], "n"), str(tmp_path / check))
        assert {tuple(r) for r in st.read("t").collect()} == {(1, "b", 2), (2, "c", 1)}


def test_patterns(spark):
    from saltmarsh.operators import bgp

    t = _quads(spark, [("data", "m:1", "p:salt", "s:1"), ("data", "m:1", "p:form", "f:1"), ("data", "m:2", "p:salt", "s:1"), ("ontology", "f:1", "p:formula", "x"), ("data", "s:1", "p:label", "Salt"), ("data", "m:1", "p:self", "m:1")]).select("s", "p", "o")
    got = bgp.select(t, ["m", "l", "f", "none"], [("?m", "p:salt", "?s")], optional=[[("?s", "p:label", "?l")], [("?m", "p:form/p:formula", "?f")]], order=["m"]).collect()
    assert [tuple(r) for r in got] == [("m:1", "Salt", "x", None), ("m:2", "Salt", None, None)]
    assert [r.m for r in bgp.select(t, ["m"], [("?m", "p:salt", "?s")], absent=[[("?m", "p:form", "?x")]]).collect()] == ["m:2"]
    assert [r.x for r in bgp.select(t, ["x"], [("?x", "p:self", "?x")]).collect()] == ["m:1"]
    with pytest.raises(ValueError):
        bgp.block(t, [("?a", "p:salt", "?b"), ("?c", "p:form", "?d")])


def test_segments(spark):
    from saltmarsh.functions.segmenter import segments, spans

    text = "It is approx. 0.084 at 900 K. Dr. X agreed (cf. Fig. 2).  Next one!\n\nNew paragraph"
    assert [text[a:b] for a, b in spans(text)] == ["It is approx. 0.084 at 900 K.", "Dr. X agreed (cf. Fig. 2).", "Next one!", "New paragraph"]
    rows = segments(spark.createDataFrame([("r", text), ("n", None), ("e", " ")], "report string, text string")).collect()
    assert [(r.report, r.seg_index) for r in rows] == [("r", 0), ("r", 1), ("r", 2), ("r", 3)] and all(text[r.char_start:r.char_end] == r.text for r in rows)


def test_bundles(spark):
    from saltmarsh.operators import bundles

    c = spark.createDataFrame([("fuel salt", "class", [("r", "d:1", "It is.", 0, 6)], [("d:1", "corpus:chemistry", 2), (None, "x", 1)])], "term string, kind string, evidence array<struct<report:string,document_iri:string,sentence_text:string,start_offset:int,end_offset:int>>, observations array<struct<document_iri:string,corpus:string,occurrence_count:int>>")
    q = bundles.bundle(c)
    assert graph.insert(q, bundles.bundle(c)).count() == q.count() == 15
    assert bundles.edited(q, "msrd:proposal-class-fuel-salt", "msr:term", "x").where("o = 'x'").count() == 1
    assert bundles.edited(q, "msrd:proposal-class-fuel-salt", "msr:note", "y").count() == 16
    assert bundles.edited(q, "msrd:proposal-class-fuel-salt", "msr:term", None).count() == 14
    i = spark.createDataFrame([("i:1", "msr:Pump"), ("i:2", "Pump"), ("i:3", "Other"), ("i:4", None)], "iri string, broader string")
    core = _quads(spark, [("ontology", "msr:Pump", "rdf:type", "owl:Class")])
    assert {r.iri: r.accepted for r in bundles.accepted(i, core).collect()} == {"i:1": True, "i:2": True, "i:3": False, "i:4": False}
    t = spark.createDataFrame([("a\n" * 60,)], "x string").select(bundles.truncated(F.col("x")).alias("t")).first().t
    assert t.truncated and t.text.count("a") == 50
    ch = spark.createDataFrame([("r", 0, 0, 3, False), ("r", 0, 5, 8, True), ("r", 0, 9, 10, False)], "report string, sentence int, start int, end int, bridge boolean")
    assert sorted((r.start, r.end, r.n) for r in bundles.bridged_chunks(ch).collect()) == [(0, 8, 2), (9, 10, 1)]


@pytest.mark.parametrize("query, ok", [
    ("select x from v where exists (with hidden as (select 1) select * from hidden)", True), ("select id from hidden where exists (with hidden as (select 1) select * from hidden)", False),
    ("with hidden as (select x from v) select * from hidden", True), ("select (select max(id) from hidden) from v", False), ("select x from V where y in (select y from v)", True),
    ("select * from range(5)", False), ("select reflect('java.lang.Math', 'abs', -1)", False), ("select * from default.hidden", False), ("select 1 union all select x from v", True), ("describe v", False),
])
def test_sql_surface_reads_nothing_else(spark, query, ok):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.range(5).createOrReplaceTempView("v")
    own = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    if ok:
        assert sqlsurface.select(spark, query, {"v": own}).count() >= 2
    else:
        with pytest.raises(sqlsurface.Refused):
            sqlsurface.select(spark, query, {"v": own})
    assert spark.table("v").count() == 5  # the caller's view of that name stays


def test_store_pointers(spark, tmp_path):
    root = tmp_path / "pointers-store"
    a, b = SnapshotStore(spark, str(root)), SnapshotStore(spark, str(root))
    a.write({"t": spark.range(1)})
    b.write({"u": spark.range(2)})  # another writer keeps what the first one wrote
    assert (a.read("t").count(), a.read("u").count()) == (1, 2)
    (root / "pointers" / "000000000003.json").write_text('{"t": "half')  # a writer that never finished
    assert a.read("t").count() == 1
    a.write({"t": spark.range(5)})
    assert (b.read("t").count(), b.read("u").count()) == (5, 2)


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from saltmarsh.session import shared_dir

    held = N(isDefined=lambda: False)
    context = N(getConf=lambda: N(get=lambda *_: None), master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: held)))
    with pytest.raises(RuntimeError):
        shared_dir(N(sparkContext=context))


def test_closure_of_a_deep_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(30)] + [("30", "0")], "src string, dst string")
    assert graph.closure(chain, spark.createDataFrame([("0",), ("7",)], "node string")).count() == 62


def test_mining_umbrella(spark):
    seg = spark.createDataFrame([("r1", 0, 30, "graphite moderator salt"), ("r1", 31, 60, "graphite moderator"), ("r2", 0, 9, "graphite"), ("r2", 10, 20, None)], "report string, char_start int, char_end int, text string")
    docs = spark.createDataFrame([(1, "graphite moderator graphite", "a"), (2, "graphite FLiBe", "b"), (3, "", None)], "doc_id int, text string, corpus string")
    men = spark.createDataFrame([("novel", "FLiBe", "r1", 3, 8), ("novel", "flibe", "r2", 1, 6), ("novel", "  ", "r2", 1, 3), ("linked", "salt", "r1", 1, 5), ("novel", None, "r1", 0, 1)], "status string, surface_form string, report string, char_start int, char_end int")
    known = mining.exclusion_keys(spark.createDataFrame([("Salt", "class")], "label string, kind string"))
    m = mining.mine_all(seg, men, docs, known, floor=1, ceiling=3)
    rows = m.candidates.collect()
    assert [(r.term, r.source, r.surface_form, r.doc_frequency, r.places, r.report, r.start_offset) for r in rows] == [
        ("flibe", "miss", "FLiBe", 1, 2, "r1", 3), ("graphite", "lexical", "", 2, 3, "r1", 0), ("graphite moderator", "lexical", "", 1, 2, "r1", 0),
    ]
    c = m.counters.first().asDict()
    assert c == {"enumerated": 7, "excluded": 3, "below_floor": 0, "cut_by_ceiling": 1, "retained": 3}
    assert {(r.term, r.document, r.occurrence_count) for r in m.observations.collect()} == {("graphite", 1, 2), ("graphite", 2, 1), ("graphite moderator", 1, 1), ("flibe", 2, 1)}
    assert mining.mine_all(seg.limit(0), men.limit(0), docs, known, floor=1).candidates.count() == 0


def test_summaries(spark):
    o = spark.createDataFrame([("property", "proposal"), ("property", "proposal"), ("class", "proposal"), (None, "dropped"), ("instance", "auto_accepted"), ("relation", "triage_rejected")], "kind string, outcome string")
    assert mining.mine_summary(o).first().asDict() == {"candidates": 6, "proposals_by_kind": {"property": 2, "class": 1}, "auto_accepted": 1, "rejected": 0, "triage_rejected": 1, "dropped_malformed": 0, "dropped": 1}
    assert mining.mine_summary(o.limit(0)).first().candidates == 0
    seen = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("c", None, "y")], "term string, document int, corpus string")
    assert tuple(mining.backfill_summary(seen.select("term").distinct(), seen, seen.limit(2)).first()) == (3, 3, 2, 2)


def test_fuzzy_candidates_lose_none(spark):
    """The indexes of possible labels against all labels."""
    import random

    r = random.Random(4)
    words = ["fuel", "salt", "drain", "tank", "loop", "pump", "LiF", "BeF2", "off-gas", "K"]
    labels = list(dict.fromkeys(" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(60)))
    d = linker.Dictionary([(f"i:{k}", "concept", [x]) for k, x in enumerate(labels)])
    for _ in range(300):
        s = list(r.choice(labels))
        for _ in range(r.randint(0, 2)):
            s[r.randrange(len(s))] = r.choice("abcxyz ")
        s = "".join(s)[r.randint(0, 2):]
        best = max((linker.weighted_ratio(s, x[0]) for x in d.labels), default=0.0)
        got = max((linker.weighted_ratio(s, d.labels[i][0]) for i in d.possible(s)), default=0.0)
        assert got == best or best < linker.FUZZY_SCORE, s


def test_quads_are_read_back(spark):
    from saltmarsh.sources import turtle

    q = spark.createDataFrame([("data", "s:1", "p:1", 'a "b"\n\\n tab\t', "literal", None, None), ("data", "s:1", "p:2", "o:1", "uri", None, None), ("vocab", "s:2", "p:1", "é", "literal", None, "fr"), ("data", "s:3", "p:1", "5", "literal", "xsd:integer", None)], turtle.QUAD)
    lines = turtle.n_quads(q)
    assert {tuple(r) for r in turtle.read_n_quads(lines).collect()} == {tuple(r) for r in q.collect()}
    blank = lines.unionByName(spark.createDataFrame([("",), ("# note",)], "value string"))
    got = turtle.import_quads(spark.createDataFrame([("data", "old", "p", "o", "uri", None, None), ("staging", "x", "p", "o", "uri", None, None)], turtle.QUAD), blank, ("data", "vocab"))
    assert got.count() == 5 and got.where("s = 'old'").count() == 0
    with pytest.raises(Exception, match="no quad"):
        turtle.read_n_quads(spark.createDataFrame([("<a> <b>",)], "value string")).collect()
    with pytest.raises(Exception, match="imported"):
        turtle.import_quads(q, lines, ("data",)).collect()
    assert turtle.cleared(q, ("data",)).count() == 1


def test_sources_of_reports(spark, tmp_path):
    from saltmarsh.sources import tabular

    c = spark.createDataFrame([("a", "raw text that is long"), ("a.normalized", "clean"), ("b", "only raw"), ("c.normalized", "other")], "document string, text string")
    assert {tuple(r) for r in tabular.one_text_each(c, ["a", "b"]).collect()} == {("a", "clean"), ("b", "only raw")}
    tabular.write_json_lines(spark.createDataFrame([(2, "é", None)], "z int, a string, m string").coalesce(1), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"é","m":null,"z":2}'
    assert tabular.selected_reports(["x", "y", "z"], ["z", "x"]) == ["x", "z"] and tabular.selected_reports(["x", "y"], limit=1) == ["x"]
    for bad in (dict(wanted=["q"]), dict(limit=0)):
        with pytest.raises(ValueError):
            tabular.selected_reports(["x"], **bad)
    rows = tabular.in_curated_order(spark.createDataFrame([("z",), ("x",), ("q",)], "report string"), ["x", "y", "z"])
    assert [r.report for r in rows.orderBy("ordinal").collect()] == ["x", "z"]


def test_bundles(spark):
    from saltmarsh.operators import bundles

    schema = "term string, kind string, run_id string, generated_at timestamp, evidence array<struct<report string, document_iri string, sentence_text string, start_offset int, end_offset int>>, observations array<struct<document_iri string, corpus string, occurrence_count int>>"
    import datetime as dt

    rows = [("Molten Salt", "lexical", f"run {k}", dt.datetime(2024, 1, k), [("R-1", "d:1", "x", 1, 5), (None, "d:1", "x", 1, 5)], [("msrd:DOC/a.b#D 1", "c", k), (None, "c", 1)]) for k in (1, 2)]
    q = bundles.bundle(spark.createDataFrame(rows, schema))
    ids = {r.s for r in q.collect()}
    assert ids == {"msrd:proposal-lexical-molten-salt", "msrd:evidence-R-1-1-5", "msrd:obs-lexical-molten-salt-d-1-run-1", "msrd:obs-lexical-molten-salt-d-1-run-2"}
    assert bundles.bundle(spark.createDataFrame(rows * 2, schema)).count() == q.count()  # written twice, nothing changes
    latest = review.breakdown(bundles.observation_rows(q)).collect()
    assert [(r.document, r.occurrence_count, r.first_observed[:10], r.last_observed[:10]) for r in latest] == [("msrd:DOC/a.b#D 1", 2, "2024-01-01", "2024-01-02")]
    guard = bundles.unit_guarded(spark.createDataFrame([(1, "u:1", None), (2, "u:9", None), (3, None, "k:1"), (4, None, "k:9"), (5, None, None)], "id int, unit string, quantity_kind string"), spark.createDataFrame([("u:1",)], "unit string"), spark.createDataFrame([("k:1",)], "quantity_kind string"))
    assert {r.id for r in guard.collect()} == {1, 3, 5}


@pytest.mark.parametrize("text, lines, size, want", [("ab\ncd\nef", 2, 99, ("ab\ncd\n", True)), ("éé", 9, 3, ("é", True)), ("é", 9, 2, ("é", False)), ("a€b", 9, 3, ("a", True)), ("😀😀", 9, 7, ("😀", True)), ("", 9, 9, ("", False)), ("abc", 9, 2, ("ab", True))])
def test_truncated_by_bytes(spark, text, lines, size, want):
    from pyspark.sql import functions as F

    from saltmarsh.operators import bundles

    r = spark.createDataFrame([(text,)], "x string").select(bundles.truncated(F.col("x"), lines, size).alias("t")).first().t
    assert tuple(r) == want


def test_edges_are_stated(spark):
    rows = [("rep", "role", "s:LiF BeF2", "r:Fuel", None, 0.8, "a"), ("rep", "role", "s:LiF BeF2", "r:Fuel", None, 0.9, None), ("rep", "reactor", "s:1", None, "x:msre", 0.7, "b"), ("rep", "role", "s:1", "r:2", None, 0.6, None)]
    d = spark.createDataFrame(rows, "report string, kind string, salt string, role string, reactor string, confidence double, rationale string")
    none = {c: F.lit(None).cast("string") for c in ("safety_function", "requirement", "property")}
    d = d.withColumns(none | {"disposition": F.when(F.col("salt") == "s:1", F.when(F.col("kind") == "role", "skipped").otherwise("written")).otherwise("written"), "reason": F.lit("")})
    e = relations.edges(d)
    assert {(r.edge_iri, r.predicate, r.confidence, r.rationale) for r in e.collect()} == {("msrd:edge-rep-LiF-BeF2-hasRole-Fuel", "msr:hasRole", 0.9, None), ("msrd:edge-rep-1-usedIn-msre", "msr:usedIn", 0.7, "b")}
    q = relations.edge_quads(e, "msrd:run-1")
    assert q.where("p = 'msr:hasRole'").select("s", "o").first() == ("s:LiF BeF2", "r:Fuel") and q.where("p = 'rdf:subject'").count() == 2 and q.where("p = 'prov:wasGeneratedBy' and o = 'msrd:run-1'").count() == 2
    assert {(r.kind, r.disposition, r.n) for r in relations.trace(d).collect()} == {("role", "written", 2), ("reactor", "written", 1), ("role", "skipped", 1)}


def test_runs_of_workers_are_those_of_columns(spark):
    terms = ["MoltenSalt", "off-gas line", "a", "", "FLiBe2 MSRSalt x", "don't"]
    got = spark.createDataFrame([(t,) for t in terms], "term string").select("term", mining.runs(mining.camel_sequence(F.col("term"))).alias("r")).collect()
    assert {r.term: set(r.r) for r in got} == {t: mining.runs_of(t) for t in terms}


def test_windows_of_a_stream(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, h, 10), "a", float(h)) for h in (1, 1, 2)] + [(dt.datetime(2024, 1, 1, 2, 50), "b", None)]
    d = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    d.where("hour(ts) = 1").write.parquet(str(tmp_path / "in"))
    d.where("hour(ts) = 2").write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda path: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.window_start.hour, r.event_type): (r.n, r.total) for r in observations.run_windows(stream(str(tmp_path / "in"))).collect()}
    assert got == {(1, "a"): (2, 2.0), (2, "a"): (1, 2.0), (2, "b"): (1, None)}
    d.limit(0).write.parquet(str(tmp_path / "none"))
    assert observations.run_windows(stream(str(tmp_path / "none"))).count() == 0
