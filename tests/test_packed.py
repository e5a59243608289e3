import pytest

from saltmarsh.operators.packed import split_packed

SCHEMA = "case_id long, source string, raw_salt string, raw_composition string, canonical string, extra int"


def _split(spark, rows):
    out: dict = {}
    for r in split_packed(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault((r.case_id, r.field), {})[r.pos] = r.val
    return {k: dict(sorted(v.items())) for k, v in out.items()}


@pytest.mark.parametrize("salt, composition, salts, values", [
    ("CsF-SrF2, NdF3", "15,7; 67,9; 16,4", ["CsF", "SrF2", "NdF3"], ["15,7", "67,9", "16,4"]),
    ("LaF3 | SrF2", '"35.5" - "64.5"', ["LaF3", "SrF2"], ["35.5", "64.5"]),
    ('"Brinolite, dried"\tBaF2', "55.4% · 44.6%", ["Brinolite, dried", "BaF2"], ["55.4%", "44.6%"]),
    ('RbF-AlF3-"Salt ""K"""', "8.8:2.5:88.7", ["RbF", "AlF3", 'Salt "K"'], ["8.8", "2.5", "88.7"]),
    ("LiF/AlF3/CsF", "3.5e-2 - 14.6 - bal", ["LiF", "AlF3", "CsF"], ["3.5e-2", "14.6", "bal"]),
    ("YF3; NdF3", "NdF3 0.0/77.6", ["YF3", "NdF3"], ["NdF3", "0.0", "77.6"]),
    ("MgF2-RbF", "RbF: 0.0 to 20.4", ["MgF2", "RbF"], ["RbF", "0.0", "20.4"]),
    ("MgF2-RbF", "0.0 - 20.4, RbF", ["MgF2", "RbF"], ["0.0", "20.4", "RbF"]),
    ("NaF–LiF–CaF2", "26.5,8.8,64.7", ["NaF", "LiF", "CaF2"], ["26.5", "8.8", "64.7"]),
])
def test_values(spark, salt, composition, salts, values):
    got = _split(spark, [(1, "a", salt, composition, None, 1)])
    assert list(got[1, "raw_salt"].values()) == salts
    assert list(got[1, "raw_composition"].values()) == values


def test_empty_place_keeps_its_number(spark):
    got = _split(spark, [(1, "a", "KF;NaF;LiF", "1.0;;bal", None, 1)])
    assert got[1, "raw_composition"] == {1: "1.0", 3: "bal"}


def test_canonical_is_counted_through(spark):
    got = _split(spark, [(1, None, None, None, 'BaF2-"Tallisol; grade B" | 22.8-77.2', 1), (2, None, None, None, "KF-ZrF4 | ZrF4 0.0-33.3", 1), (3, None, None, None, "LiF-100.0", 1)])
    assert list(got[1, "canonical"].values()) == ["BaF2", "Tallisol; grade B", "22.8", "77.2"]
    assert list(got[2, "canonical"].values()) == ["KF", "ZrF4", "ZrF4", "0.0", "33.3"]
    assert list(got[3, "canonical"].values()) == ["LiF", "100.0"]


def test_defined_results(spark):
    rows = [(1, None, None, None, None, None), (2, "a", "", "n/a", " ", None), (3, "a", "LiF", "100.0", None, None), (4, "a", "KF-NaF", "1.0-99.0", None, 1), (4, "a", "KF-NaF", "1.0-99.0", None, 1)]
    got = _split(spark, rows)
    assert set(got) == {(4, "raw_salt"), (4, "raw_composition")}
    assert _split(spark, []) == {}


def test_long_field(spark):
    n = 3000
    got = _split(spark, [(1, "a", ";".join(["LiF"] * n), ";".join(["1.0"] * n), None, 1)])
    assert len(got[1, "raw_salt"]) == n == len(got[1, "raw_composition"])


def test_very_many_quoted_values(spark):
    got = _split(spark, [(1, "a", ";".join(f'"{k}"' for k in range(7000)), None, None, 1)])
    assert got[1, "raw_salt"] == {k + 1: str(k) for k in range(7000)}


def test_all_separators_at_once(spark):
    got = _split(spark, [(1, "a", "A-B–C/D+E;F,G|H:I·J\tK", None, None, 1)])
    assert list(got[1, "raw_salt"].values()) == list("ABCDEFGHIJK")


def test_private_characters_are_ordinary(spark):
    got = _split(spark, [(1, "a", 'A\ue001;"B"', "1;2", None, 1)])
    assert got[1, "raw_salt"] == {1: "A\ue001", 2: "B"}


def test_the_source_decides_where_the_record_is_silent(spark):
    """`22,77` without a companion: two values where the source parts by commas, one number where it writes decimal commas."""
    parts = [(k, "parts", "KF;NaF", f"{k},{99 - k}", None, 1) for k in range(1, 60)]
    decimals = [(100 + k, "decimals", "KF;NaF", f"{k},5;{99 - k},5", None, 1) for k in range(1, 60)] + [(200 + k, "decimals", "KF", f"99,{k}", None, 1) for k in range(1, 60)]
    got = _split(spark, parts + decimals + [(500, "parts", None, "22,77", None, 1), (501, "decimals", None, "22,77", None, 1)])
    assert got[500, "raw_composition"] == {1: "22", 2: "77"}
    assert (501, "raw_composition") not in got


def test_scores_joined_by_source_give_the_same(spark):
    rows = [(1, "a", "CsF-SrF2, NdF3", "15,7; 67,9; 16,4", None, 1), (2, "b", "LiF/AlF3/CsF", "3.5e-2 - 14.6 - bal", "AlF3-LiF | 1-2", 1), (3, None, "KF;;LiF", "1.0;;bal", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(split_packed(df, most_scores=0).collect()) == sorted(split_packed(df).collect())
