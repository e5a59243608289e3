from collections import Counter

import pytest

from saltmarsh.llm import sentences as S
from saltmarsh.llm.languages import Language, label_code, language_stretches, without_page_matter, words_of, wrong_labels
from saltmarsh.llm.scans import Matter, Model, decode, learn_matter, line_shape, repair, repair_scans, repaired_pages, repaired_text, trained

CORPUS = """Above 900 K, the salt turned dark. Nobody expected the density to matter. The crew weighed screws, washers, etc. Above 910 K, Dr. Marrowby noted a change.

Nobody saw it! Above all, the value (cf. Table 2) rose to 5.4 at 7 p.m. Nobody knew. See Fig. 3 and Fig. 4 for the rest. Dr. Marrowby and Dr. Kastovar of the U.S. Survey agreed.

The shift ended at 9 p.m. The salt froze. Flow stopped at 8 a.m. Monday and resumed. At 4 p.m. and 5 p.m. the pump ran; screws, etc. were weighed. In the log of the U.S. Survey it is. Eq. (6) and App. B of it hold."""


@pytest.fixture(scope="module")
def st():
    c = Counter()
    for _ in range(5):
        S.evidence(CORPUS, c)
    return S.Statistics.of(c)


def cut(text, st):
    return [text[a:b] for a, b in S.sentences(text, st)]


@pytest.mark.parametrize("text, want", [
    ("The crew weighed screws, etc. Above 910 K, it rose. See Fig. 3 now.", 3), ("The shift ended at 9 p.m. Nobody knew.", 2), ("Flow stopped at 8 a.m. Monday and resumed.", 1), ("Dr. Marrowby of the U.S. Survey agreed.", 1),
    ("It rose to 5.4 units. Nobody knew.", 2), ("See Eq. (6) and App. B of it.", 1), ('"The pump held. We saw no loss," wrote Marrowby in the log. Nobody knew.', 2), ("It held.Nobody knew.", 2), ("Why not? Nobody knew!", 2),
    ("(Details are given in Sec. 3.5.) Above 900 K, it rose.", 2), ("Losses were 8 kW... a figure too low. Nobody knew.", 2),
    ("熔盐冷却以后,循环未能恢复。“回路没有泄漏。我们没有看到损失。”Zorvath在日志中写道。必须更换！", 3), ("「ループは漏れなかった。損失もない。」とZorvathは記録している．密度は3.5であった．", 2),
    ("เราวัดความหนาแน่นของเกลือ MgF2-RbF ที่อุณหภูมิ 760 เคลวิน ปริมาณของ LiF เพิ่มขึ้นอย่างช้าๆ", 2), ("การไหลเวียนไม่สามารถกลับคืนมาได้ Nobody expected the density to matter.", 2), ("7.3. Density of KF-CaF2\n\nNobody knew.", 2),
    ("Nobody\nexpected the\ndensity. Above\nall, it rose.", 2),
])
def test_sentences(text, want, st):
    got = cut(text, st)
    assert len(got) == want, got
    assert "".join("".join(got).split()) == "".join(text.split())


def test_sentences_of_nothing(st):
    assert [S.sentences(t, st) for t in (None, "", "  \n\n ")] == [[], [], []]
    assert S.sentences("x" * 100_000, st) == [(0, 100_000)] and S.sentences('A "b. c', st) == [(0, 7)]


def test_the_document_speaks_before_the_corpus():
    st = S.Statistics({"The": 0.9, "Quill": 0.9}, {"Alloy": (0.9, 0.0), "cat": (0.0, 0.4)})
    # the corpus calls `Alloy.` an abbreviation that ends no sentence; in the document it ends some, as `the` shows
    assert len(cut("We bought an Alloy. The pump ran. We saw the Alloy. The loop was cold.", st)) == 4
    # the corpus calls `cat.` a word; in the document it is an abbreviation before a name
    doc = "See cat. 5 and cat. 7 for it. We read cat. Quill there, as Quill was; Quill said so, and Quill knew."
    assert len(cut(doc, st)) == 2
    # where the document doesn't say, the corpus does
    assert len(cut("We bought an Alloy. The pump ran.", st)) == 1


def test_long_documents_take_linear_time(st):
    import time

    text = "The salt was heated to 800 K. Alloy No. 5 failed. Dr. Smith, approx. 4 h later, said so etc. The pump ran. " * 2800
    began = time.process_time()
    assert len(S.sentences(text, st)) > 8000 and time.process_time() - began < 1.0


def test_long_headings_and_abbreviations(st):
    heading = "7.3. " + "Density of KF-CaF2 and " * 20 + "others"
    assert S.sentences(heading + "\n\nNobody knew.", st) == [(0, len(heading)), (len(heading) + 2, len(heading) + 14)]
    word = "Superkalifragilistisch"
    assert len(cut(f"It was {word}. 5 and {word}. 6 now, then {word}. Marrowby went", st)) == 1


def test_documents_with_segments(spark):
    d = spark.createDataFrame([(1, "Nobody knew. Above all, it rose."), (2, "Not asked."), (3, None)], "doc_id long, text string")
    s = spark.createDataFrame([(1, "para", 0), (1, "para", 0), (2, "page", 0), (3, "para", 0)], "doc_id long, layout string, text int")
    got = sorted(tuple(r) for r in S.split_documents(d, s).collect())
    assert got == [(1, 0, 12), (1, 13, 32)]
    assert S.split_documents(d.limit(0), s).count() == 0


# ---- scans


@pytest.fixture(scope="module")
def model():
    words = "the salt in pump bowl turned dark because of a change solubility temperature conductivity well-documented Osterlund-Vey MgF2 UF4 from held at was dense deposit value under argon K Alloy 0 non-linear".split()
    return Model({w: 100.0 for w in words}, {(a, b): 20 for a, b in zip(words, words[1:])})


@pytest.mark.parametrize("line, want", [
    ("the s0lubility was", ["solubility"]), ("the so1ubil!ty of", ["solubility"]), ("in the purnp bowl", ["pump"]), ("turnecl dark", ["turned"]), ("the tempe rature of", ["temperature"]), ("dense MgF, deposit", ["MgF2"]),
    ("held at 82S K", ["825"]), ("a† 900", ["at"]), ("the unknownword of", []), ("All0y was held", ["Alloy"]), ("the váluc, of", ["value"]), ("", []),
])
def test_decode(line, want, model):
    assert [w for _, _, w in decode(line.split(), model)] == want


def test_frequent_misreadings_stay_doubtful(spark):
    """A misreading is no word however often it is read: ten times the input gives the same repairs."""
    clean, read = "the curve showed a station near the pump", "the curvc showcd a sta-\ntion near the curve"
    for times in (1, 10, 100):
        rows = [("para", clean)] * (40 * times) + [("page", read)] * (6 * times) + [("para", "curvc tion")] * (times > 10)
        m, _ = trained(spark.createDataFrame(rows, "layout string, text string"))
        assert not m.knows("curvc") and not m.knows("tion") and m.knows("curve")
        assert repair(read, None, None, False, m) == [(1, "char", "curve"), (1, "char", "showed"), (1, "joined", "station")], times


def test_page(model):
    page = "MSX-TM-1027  —  Chemistry of the Ostrel pump bowl\nthe salt in the pump bowl turned dark beca- \nuse of a change of solu\nbility. Osterlund-\nVey held the tem-\n18"
    following = "19    Chemistry of the pump bowl\nperature, of dense salt.\n\n[19]"
    got = repair(page, following, "MSX-TM-1027", False, model)
    assert got == [(1, "furniture", ""), (6, "furniture", ""), (2, "joined", "because"), (3, "joined", "solubility"), (4, "joined", "Osterlund-Vey"), (5, "joined", "temperature")]
    assert repair(following, None, "MSX-TM-1027", False, model) == [(1, "furniture", ""), (4, "furniture", "")]
    assert repaired_text(page, "MSX-TM-1027", model) == "the salt in the pump bowl turned dark because of a change of solubility. Osterlund-Vey held the tem-"


def test_paragraphs_over_pages(spark):
    clean = "the salt in the pump held at a dense temperature of the bowl"
    pages = ["MSX-TM-1027\nthe salt held the tem-\n18", "19    Chemistry of the pump bowl\nperature of the bowl\n\nthe salt in the\nbo-", "wl held at a\ntem-", "perature."]
    rows = [(i, 0, i, "r", "para", clean) for i in range(30)] + [(100 + i, 7, i, "MSX-TM-1027", "page", p) for i, p in enumerate(pages)]
    segments = spark.createDataFrame(rows, "segment_id long, doc_id long, seg_index int, report string, layout string, text string")
    evidence = spark.createDataFrame([(5, "MSX-TM-1027", "held at a tem-\n\n[19]\n\nperature of the sa-\nlt"), (6, None, None)], "evidence_id long, report string, sentence_text string")
    got = sorted(tuple(r) for r in repaired_pages(segments, evidence).collect())
    assert got == [
        ("evidence", 5, "held at a temperature of the salt"), ("evidence", 6, ""),
        ("segments", 100, "the salt held the temperature"), ("segments", 101, "of the bowl\n\nthe salt in the bowl"), ("segments", 102, "held at a temperature."), ("segments", 103, ""),
    ]


@pytest.mark.parametrize("line, is_it", [
    ("Page 28 of 83", True), ("xxxviii", True), ("- 21 -", True), ("[13]", True), ("BEHAVI0UR OF THE HAVENROOK PUMP", True), ("Quendle Laboratory Progress Notes", True), ("MSX-TM-l027", True), ("15    Survey of the Garrowby drain tank", True),
    ("the salt turned dark.", False), ("Mr. Kastovar and Mrs. Welloway", False), ("Above 900 K the pump", False),
])
def test_furniture(line, is_it):
    matter = Matter(frozenset({"C # l #", "U+", "C+"}))
    page = [line, "the salt in the pump turned dark", "again and again."]
    assert (0 in matter.lines(page, "MSX-TM-1027", False)) is is_it


@pytest.mark.parametrize("line, shape", [("Page 12345 of 20000", "C # l #"), ("SURVEY 0F THE PUMP    9", "U+ #"), ("MSX-TM-l027/54", "R#"), ("MSX-TM-1027  —  Survey of the pump", "R — C l+"), ("- xxi -", "- r -"), ("a value, of 35", "l l, l #")])
def test_shapes(line, shape):
    assert line_shape(line, "MSX-TM-1027") == shape


def test_page_matter_is_learnt_from_repetition(spark):
    """Headers are known by standing at the edges of many pages; page numbers of any size, any number of lines at an edge."""
    body = "the salt turned dark in the\npump and nobody knew why it\nhad been held there for so\nlong before the crew came."
    rows = [("MSX-1", f"Notes From The Cellar\nPage {12340 + k} of 20000\nseries b, volume iv\n{chr(97 + k) * 3} {body.replace("t", chr(97 + k))}\n{chr(97 + k) * 5}, kept\n{k + 12345}") for k in range(20)]
    rows += [("MSX-2", f"Old Tales Of Salt\n{body.replace("t", chr(97 + k))}\nand so on") for k in range(3)]
    rows += [(f"MSX-{k}", f"Page {12345 * k} of 200000\n{body}\n{body}") for k in range(3, 15)]
    matter, running = learn_matter(spark.createDataFrame(rows, "report string, text string"))
    often = {r.report: frozenset(r.running) for r in running.collect()}
    page = rows[5][1].split("\n")
    assert matter.lines(page, "MSX-1", False, often["MSX-1"]) == {0, 1, 2, len(page) - 1}
    assert matter.lines(rows[21][1].split("\n"), "MSX-2", False, often["MSX-2"]) >= {0}
    assert matter.lines(["Page 12345 of 20000", "the salt", "12345"], "MSX-9", False) == {0, 2}


def test_words_of_any_length_and_any_number_of_confusions():
    long = "donau" + "dampfschifffahrts" * 3 + "gesellschaft"
    m = Model({w: 100.0 for w in ("the", "international", long, "was", "held")}, {})
    assert len(long) > 60
    read = long.replace("d", "cl", 1).replace("m", "rn", 1).replace("a", "á", 1)
    assert [w for _, _, w in decode(["the", read, "was"], m)] == [long]
    assert [w for _, _, w in decode(["the", "1ntcrnat1ona1", "was"], m)] == ["international"]
    likely = Model(m.words, {}, dict.fromkeys(m.confusions, 1e-3))
    assert [w for _, _, w in decode(["the", "1ntcrnát1ona1", "was"], likely)] == ["international"]  # five
    assert decode(["the", "x" * 5000, "was"], m) == []


def test_nothing_to_repair(model):
    assert repair(None, None, None, False, model) == repair(" \n ", "x", None, True, model) == []
    assert repaired_text("", None, model) == ""


# ---- languages


@pytest.mark.parametrize("label, code", [("en_GB", "en"), (" EN ", "en"), ("French", "fr"), ("deu", "de"), ("zh-CN", "zh"), ("xx", None), ("", None), (None, None), ("n/a", None), ("und", "und"), ("日本語", "ja")])
def test_labels(label, code):
    assert label_code(label) == code


def test_words_are_no_formulas():
    assert words_of("The ThF4-KF melt at 900 K (UF4) l'ordre Salz 熔盐冷却 เกลือ DENSITY LiF") == ["the", "melt", "at", "l'ordre", "salz", "熔盐冷却", "เกลือ"]


def test_page_matter_keeps_offsets():
    t = "12    Survey of the Ostrel Pump\nhello there\n[12]\n\fXII\nworld again\n- 13 -"
    clean = without_page_matter(t, None, Matter())
    assert len(clean) == len(t) and clean.split() == ["hello", "there", "world", "again"] and clean.index("world") == t.index("world")


def test_model_sums_to_one():
    m = Language({"abba": 3, "baab": 2, "b": 5})
    assert all((p <= 0).all() for _, p in m.grams)


EN = "the salt in the pump turned dark and nobody expected the density to matter when the heaters were cold"
DE = "das salz verfärbte sich dunkel und niemand rechnete damit dass die dichte eine rolle spielt nach dem abkühlen"


def test_stretches(spark):
    def text(words, k):
        w = words.split()
        return " ".join(w[k % len(w):] + w[:k % len(w)]).capitalize() + "."

    rows = [(i, " ".join(text(EN, i + j) for j in range(4)), "en", "r") for i in range(30)] + [(100 + i, " ".join(text(DE, i + j) for j in range(4)), "German", "r") for i in range(30)]
    mixed = text(EN, 3) + " " + text(DE, 5)
    rows += [(200, text(DE, 2) + " " + text(DE, 7), "en", "r"), (201, mixed, "en", "r"), (202, "UF4  3.5  —  9.1e+00", "en", "r"), (203, None, "en", "r"), (204, " \n ", None, "r"), (205, text(EN, 1), None, None), (205, text(EN, 1), None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, report string").withColumn("confidence", __import__("pyspark").sql.functions.lit(1))
    got = sorted(tuple(r) for r in wrong_labels(d).collect())
    assert got == [(200, 0, "de"), (201, 0, "en"), (201, len(text(EN, 3)) + 1, "de"), (202, 0, "und"), (205, 0, "en")]
    conf = [r.confidence for r in language_stretches(d).collect()]
    assert all(0 <= c <= 1 for c in conf)


def test_no_documents(spark):
    assert wrong_labels(spark.createDataFrame([], "doc_id long, text string, lang string, report string")).count() == 0


def test_rejection_is_calibrated_for_stretches_too(spark):
    """A text in no known language is `und`, alone and within a document; texts of the sample aren't."""
    import random

    r = random.Random(1)
    lines = {"en": "the pump of the loop was stopped and the salt in the tank has been cooled by the crew at night", "de": "die Pumpe wurde angehalten und das Salz in dem Tank ist von der Mannschaft in der Nacht gekühlt worden"}
    rows = []
    for k in range(900):
        code = "en" if k % 2 else "de"
        text = " ".join(" ".join(r.choice(lines[code].split()) for _ in range(12)).capitalize() + "." for _ in range(6))
        rows.append((k, text, code, None))
    odd = " ".join("".join(r.choice("qxzwvkj") for _ in range(7)) for _ in range(30)).capitalize() + "."
    rows += [(1000, odd, None, None), (1001, f"{rows[1][1]}\n\n{odd} {odd}", None, None)]
    got: dict = {}
    for x in language_stretches(spark.createDataFrame(rows, "doc_id long, text string, lang string, report string")).collect():
        got.setdefault(x.doc_id, []).append((x.char_start, x.lang, x.confidence))
    assert [x[1] for x in got[1000]] == ["und"] and [x[1] for x in sorted(got[1001])] == ["en", "und"]
    assert all(len(got[k]) == 1 and got[k][0][1] == ("en" if k % 2 else "de") for k in range(900))
    assert all(0.0 < p <= 1.0 for v in got.values() for _, _, p in v)
