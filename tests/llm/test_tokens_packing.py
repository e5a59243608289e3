import random
from collections import Counter
from pathlib import Path

import pytest

from saltmarsh.llm.packing import ATTENTION, CAPACITY, FULL, LENGTHS, best_plan, pack, plan
from saltmarsh.llm.tokens import VOCABULARIES, Encoder, encode_documents

FILE = Path(VOCABULARIES) / "byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(FILE))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encodings_are_those_of_the_public_library(reference):
    random.seed(1)
    pieces = ["a", "ab", "aaa", "the", " ", "  ", "\n", "\t", "1", "é", "漢字", "ไท", "\x85", "\xa0", "　", "<|endoftext|>", "'s", "½", "😀", "\r\n", "\x00", "ing", "--", "UF4", "=="]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(random.randint(97, 102)) for _ in range(random.randint(1, 60))) for _ in range(3000)] + ["ab" * 50_000]
    e = Encoder(FILE.read_text())
    assert e.encode(texts) == reference(texts)
    assert e.encode([None, ""]) == [[], []]


def test_documents(spark, reference):
    rows = [(1, "Molten salt", 5), (1, "Molten salt", 5), (2, None, 1), (3, "", 1)]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    ids = reference(["Molten salt"])[0]
    assert sorted((r.doc_id, list(r.ids)) for r in got) == [(1, ids), (1, ids), (2, []), (3, [])]
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _check(h: Counter) -> int:
    seen, bins = Counter(), {}
    for size, first, each, count, bin_, offset, length in plan(dict(h)):
        seen[size] += each * count
        for b in range(count):
            bins.setdefault(bin_ + b, (length, []))[1].extend((offset + i * size, size) for i in range(each))
    assert seen == h
    for length, items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


def test_plan_places_every_item_once():
    random.seed(0)
    for _ in range(60):
        h = Counter(random.choice([random.randint(1, CAPACITY), random.randint(1, 300), 777]) for _ in range(random.randint(1, 300)))
        assert _check(h) >= sum(s * n for s, n in h.items()) / CAPACITY
    assert _check(Counter({1: 5000})) == 3
    assert plan({}) == []


def test_containers(spark):
    items = [(i, s) for i, s in enumerate([5000, 2048, 2047, 1, 0, None, 700, 700, 700, 300])]
    rows = pack(spark.createDataFrame(items, "item long, size int")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.item, []).append(r)
        assert r.bin_offset + r.size <= r.bin_length <= CAPACITY
    assert set(by) == {0, 1, 2, 3, 6, 7, 8, 9}
    assert [(r.start, r.size) for r in sorted(by[0], key=lambda r: r.part)] == [(0, 2048), (2048, 2048), (4096, 904)]
    assert all(len(v) == 1 for k, v in by.items() if k)
    assert pack(spark.createDataFrame([], "item long, size int")).count() == 0


def test_a_hot_size(spark):
    rows = pack(spark.range(5000).selectExpr("id AS item", "500 AS size")).toPandas()
    assert rows.groupby("bin")["size"].sum().max() <= CAPACITY and len(rows) == 5000 and rows["bin"].nunique() == 1250
    assert not rows.duplicated(["bin", "bin_offset"]).any()


def _cost(rows, cost):
    return sum(cost(r[6]) * r[3] for r in rows if r[5] == 0)


def test_lengths_are_chosen_jointly():
    random.seed(3)
    h = Counter(min(CAPACITY, int(random.lognormvariate(5, 1)) + 1) for _ in range(20000))
    full, mixed = best_plan(h), best_plan(h, cost=ATTENTION)
    assert {r[6] for r in full if r[3] > 1} == {2048} and len({r[6] for r in mixed if r[3] > 1}) >= 3
    one = plan(h, (2048,), ATTENTION, LENGTHS)
    assert _cost(mixed, ATTENTION) < 0.9 * _cost(one, ATTENTION) and _cost(full, FULL) <= _cost(mixed, FULL)
    tokens = sum(s * n for s, n in h.items())
    for rows in (full, mixed):
        assert sum(r[0] * r[2] * r[3] for r in rows) == tokens
        assert sum(r[6] * r[3] for r in rows if r[5] == 0) < 1.02 * tokens
