import random
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import looks
from weftline.llm.mixing import expected_copies, mix
from weftline.llm.packing import pack, pack_each, plan_bins
from weftline.llm.tokens import with_tokens


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 40), max_size=20))))
def test_plans_place_every_item_once(case):
    capacity, counts = case
    plan = plan_bins(counts, capacity)
    placed = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(s * k for s, k in pattern.items()) <= capacity
        for s, k in pattern.items():
            placed[s] += k * n
    assert placed == Counter({s: n for s, n in counts.items() if n})
    bins, total = sum(n for _, n in plan), sum(s * n for s, n in counts.items())
    assert bins <= 2 * -(-total // capacity) + 1


def test_large_items_pair():
    assert sum(n for _, n in plan_bins({60: 10, 40: 10}, 100)) == 10
    assert sum(n for _, n in plan_bins({50: 11, 5: 10}, 100)) == 6
    with pytest.raises(ValueError):
        plan_bins({101: 1}, 100)


def test_pack(spark):
    rng = random.Random(4)
    rows = [(f"d{i:03d}", rng.choice([None, 0, 7, 7, 7, rng.randrange(1, 350)])) for i in range(300)] + [("same", 7)] * 5
    df = spark.createDataFrame([(i, s, 1) for i, s in rows], "id string, size int, bin_id int")
    out = pack(df, "id", "size", 100).collect()
    fill = Counter()
    for r in out:
        if r.bin_id is not None:
            fill[r.bin_id] += r.length
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) == sum(s or 0 for _, s in rows)
    pieces = {}
    for r in out:
        pieces.setdefault(r.id, []).append((r.offset, r.length))
    for i, s in rows:
        if i != "same" and s:
            at = 0
            for offset, length in sorted(pieces[i]):
                assert offset == at
                at += length
            assert at == s and len(pieces[i]) == -(-s // 100)
    assert len(pieces["same"]) == 5 and {r.id for r in out} == {i for i, _ in rows}
    assert pack(df.limit(0), "id", "size", 100).count() == 0


def test_each_capacity_is_packed_as_if_alone(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 0, 7, 7, 30, 31, 200, 400, rng.randrange(1, 900)])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, size int").repartition(5)
    out = pack_each(df, "id", "size", [31, 200, 100, 100]).collect()
    for capacity in (31, 100, 200):
        own = [r for r in out if r.capacity == capacity]
        alone = pack(df, "id", "size", capacity).collect()
        fill = Counter()
        for r in own:
            if r.bin_id is not None:
                fill[r.bin_id] += r.length
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert sorted((r.id, r.piece, r.offset, r.length) for r in own) == sorted((r.id, r.piece, r.offset, r.length) for r in alone)
        assert len(fill) == len({r.bin_id for r in alone} - {None}) and {r.id for r in own} == {i for i, _ in rows}
    assert pack_each(df, "id", "size", []).count() == 0
    with pytest.raises(ValueError):
        pack_each(df, "id", "size", [5, 0])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 9), (2, "", 9), (3, None, 9), (4, "<|endoftext|>", 9), (5, "word " * 20_000, 9)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in with_tokens(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 20_000


def test_expected_copies():
    e = expected_copies({"a": 100.0, "b": 10.0}, {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 9)})
    assert e["b"] == 3.0 and abs(e["a"] * 100 / (e["b"] * 10) - 5 / 3) < 1e-9 and "c" not in e
    assert expected_copies({"a": 10.0}, {"a": (1.0, 2)}, total=100) == {"a": 2.0}
    assert expected_copies({}, {"a": (1.0, 2)}) == {}


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "big", rng.randrange(1, 60)) for i in range(2000)] + [(3000 + i, "small", rng.randrange(1, 60)) for i in range(80)]
    rows += [(4000, None, 5), (4001, "alone", 5), (4002, "small", None), (4003, "small", 0)]
    df = spark.createDataFrame([(i, s, n, "x") for i, s, n in rows], "id int, source string, size int, copies string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 4), ("nothing", 0.1, 2)], "source string, target_share double, max_repeats int")
    result = mix(df, "id", "source", "size", targets)
    copies = {r.id: r.copies for r in result.copies.collect()}
    assert set(copies) == {i for i, s, _ in rows if s in ("big", "small")}
    report = {r.source: r for r in result.report.collect()}
    assert set(report) == {"big", "small", "nothing", "alone", None}
    assert abs(report["big"].actual_share - 0.8) < 0.01 and abs(report["small"].actual_share - 0.2) < 0.01
    assert report["small"].most_repeats <= 4 and report["big"].most_repeats <= 1 and report["nothing"].actual_share == 0
    assert copies[4002] == copies[4003] == 0
    for seed in range(4):  # whatever the offset, no source is off by more than its largest record
        for r in mix(df, "id", "source", "size", targets, seed=seed).report.filter("size_goal > 0").collect():
            assert abs(r.size_error) <= r.error_bound == max(n or 0 for _, s, n in rows if s == r.source) and abs(r.size_used - r.size_goal - r.size_error) < 1e-6
    assert {r.id: r.copies for r in mix(df, "id", "source", "size", targets).copies.collect()} == copies
    empty = mix(df.limit(0), "id", "source", "size", targets)
    assert empty.copies.count() == 0 and empty.report.count() == 3


POOL = [*map(chr, range(0x41, 0x250)), *map(chr, range(0x300, 0x370)), *map(chr, range(0x400, 0x500)), *map(chr, range(0x1E00, 0x2000)), *map(chr, range(0xAC00, 0xAC80)), *map(chr, range(0x1100, 0x1200)), *map(chr, range(0x915, 0x960)), " ", "\n"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(POOL), max_size=12)), max_size=40))
def test_composition_is_canonical(texts):
    got = looks.unify(pa.array(texts, pa.string()), looks=False).to_pylist()
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    once = looks.unify(pa.array(texts, pa.string()))
    assert looks.unify(once).to_pylist() == once.to_pylist()
    apart = pa.array([None if t is None else unicodedata.normalize("NFD", t) for t in texts], pa.string())
    assert looks.unify(apart).to_pylist() == once.to_pylist() == looks.unify_in_pieces(pa.array(texts, pa.string())).to_pylist()


def form(text):
    return looks.unify(pa.array([text])).to_pylist()[0]


def test_what_looks_the_same():
    for a, b in [("ｆｕｌｌ　ｗ", "full w"), ("ﬁle oﬃce", "file office"), ("a b c d", "a b c d"), ("so­ft​‍﻿", "soft"), ("раssword", "password"), ("é", "é"), ("ё", "ë"), ("й", "й"), ("Ο", "O"), ("e​́", "é")]:
        assert form(a) == form(b)
    for a, b in [("a", "A"), ("e", "é"), ("1", "2"), ("a.", "a,"), ("x²", "x2"), ("①", "1"), ("…", "..."), ("a b", "ab"), ("a  b", "a b"), ("l", "1")]:
        assert form(a) != form(b)
    assert form("") == "" and form("​") == "" and len(form("é" * 300_000)) == 300_000 and form("a" + "́" * 5000)


def test_words_keep_their_alphabet():
    assert form("Пaнeль") == "Панель" == form("Панель") and form("нe") == "не"
    assert form("отчёт") == "отчёт" == form("oтчëт")
    assert form("сору") == "copy" and form("cop\u0443 жук") == "copy жук" and form("жdк") == "жdк"
    assert form("λόγος") == "λόγος" == form("λ\u00f3γος")


def test_same_look_pairs(spark):
    rows = [(1, "abc"), (2, "аbс"), (3, "abc"), (4, "ab​c"), (5, None), (6, ""), (7, " "), (8, " "), (9, "other"), (10, "​")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, look string")
    got = {(r.doc_a, r.doc_b) for r in looks.same_look_pairs(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    classes = {r.id: (r.look_id, r.form_id, r.n_forms) for r in looks.same_look_classes(df, "doc_id", "text").collect()}
    assert classes == {1: (1, 1, 3), 3: (1, 1, 3), 2: (1, 2, 3), 4: (1, 4, 3), 9: (9, 9, 1)}
    assert looks.same_look_pairs(df.limit(0), "doc_id", "text").count() == 0
    assert df.select(looks.common_form(F.col("text"))).count() == 10
