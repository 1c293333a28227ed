import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import distinct as D
from weftline.llm.neardup import Threshold, near_duplicate_groups, near_duplicates
from weftline.llm.terms import terms_of


def records(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        base = rng.sample(words[: 60 + i], rng.randrange(1, 40))
        rows.append(base)
        for _ in range(rng.randrange(3)):
            changed = [w for w in base if rng.random() > 0.12] + rng.sample(words, rng.randrange(3))
            rng.shuffle(changed)
            rows.append(changed + changed[:2])
    rows += [[], None, ["same"], ["same", "same"], ["same", None, ""], [f"z{i}" for i in range(5000)], [f"z{i}" for i in range(300, 5300)], ["a", "b"], ["b", "a"]]
    return list(enumerate(rows))


def brute(rows, t):
    sets = {i: frozenset(w for w in r or [] if w) for i, r in rows}
    sets = {i: s for i, s in sets.items() if s}
    least = {}
    for i, s in sets.items():
        least[s] = min(i, least.get(s, i))
    items = sorted((i, s) for s, i in least.items())
    pairs = {(a, b) for a, x in items for b, y in items if a < b and len(x & y) * t.den >= len(x | y) * t.num}
    return {i: least[s] for i, s in sets.items()}, pairs


@pytest.mark.parametrize("threshold,tile", [(Threshold(), 2048), (Threshold(), 3), (Threshold(4, 5), 16), (Threshold(1, 2), 5)])
def test_pairs_against_brute_force(spark, threshold, tile):
    rows = records()
    df = spark.createDataFrame([(i, r, "x", 1) for i, r in rows], "id long, terms array<string>, key string, class_id int")
    found = near_duplicates(df, "id", "terms", threshold, tile)
    members, pairs = brute(rows, threshold)
    assert {r.id: r.class_id for r in found.members.collect()} == members
    assert {(r.class_a, r.class_b) for r in found.pairs.collect()} == pairs


def test_groups_and_links(spark):
    rows = records(2)
    df = spark.createDataFrame(rows, "id long, terms array<string>")
    found = near_duplicates(df, "id", "terms")
    members, pairs = brute(rows, Threshold())
    got = {r.id: r for r in near_duplicate_groups(found).collect()}
    near = lambda a, b: a != b and (members[a] == members[b] or (min(members[a], members[b]), max(members[a], members[b])) in pairs)
    assert all(r.n_links == sum(near(i, j) for j in members) for i, r in got.items())
    assert all(got[a].group_id == got[b].group_id for a, b in pairs)
    assert set(got) == set(members)


def test_no_records(spark):
    none = spark.createDataFrame([], "id long, terms array<string>")
    found = near_duplicates(none, "id", "terms")
    assert found.members.count() == 0 and found.pairs.count() == 0 and near_duplicate_groups(found).count() == 0


def test_terms(spark):
    df = spark.createDataFrame([("Ab ABC 1abc a1b", "x-ray ray_2 foo99"), (None, None)], "t string, b string")
    got = [r[0] for r in df.select(terms_of(F.col("t"), F.col("b"))).collect()]
    assert got == [["abc", "a1b", "ray", "ray", "foo99"], []]


def exact_tail(k, n, marked, total):
    top = min(n, marked)
    ways = sum(math.comb(marked, x) * math.comb(total - marked, n - x) for x in range(k, top + 1) if 0 <= n - x <= total - marked)
    return Fraction(ways, math.comb(total, n))


def test_hypergeometric_tail_is_exact():
    rng = random.Random(3)
    for _ in range(400):
        total = rng.randrange(2, 400)
        marked, n = rng.randrange(1, total + 1), rng.randrange(1, total + 1)
        k = rng.randrange(0, min(n, marked) + 1)
        p = exact_tail(k, n, marked, total)
        got = D.log10_upper_tail([k], [n], [marked], total)[0]
        assert abs(got - (math.log10(p.numerator) - math.log10(p.denominator))) < 1e-8 * max(1, abs(got))
    assert D.log10_upper_tail([3], [5], [2], 10)[0] == -np.inf
    x = np.array([1.0, 2.0, 10.5, 1e6, 1e12])
    assert np.allclose(D.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)


@pytest.mark.parametrize("total", [10**7, 10**11, 10**13])
def test_tail_of_a_large_collection(total):
    """Against whole numbers: the common factors of the first term and the others, without a rounding."""
    rng = random.Random(total)
    for _ in range(12):
        marked, n = rng.choice([1, 7, 300, total // 10**5, total // 50]), rng.choice([1, 40, 900, 3000])
        k = rng.randrange(1, min(n, marked, 60) + 1)
        if k <= n * marked / total:
            continue
        ways = math.comb(marked, k) * math.comb(total - marked, n - k)
        first, tail = ways, ways
        for x in range(k, min(n, marked)):
            ways = ways * (marked - x) * (n - x) // ((x + 1) * (total - marked - n + x + 1))
            tail += ways
            if ways * 10**30 < first:
                break
        exact = math.log10(tail) - math.log10(math.comb(total, n))
        assert abs(D.log10_upper_tail([k], [n], [marked], total)[0] - exact) < 1e-9


def test_counts_and_enrichment(spark):
    rows = [(0, ["a", "a", "b"]), (1, ["b", "c"]), (2, ["b", None]), (3, None), (4, [])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc int, terms array<string>, term string, tf int")
    counts = D.term_counts(df, "doc", "terms").cache()
    assert {(r.id, r.term, r.tf, r.max_tf, r.length) for r in counts.collect()} == {(0, "a", 2, 2, 3), (0, "b", 1, 2, 3), (1, "b", 1, 1, 2), (1, "c", 1, 1, 2), (2, "b", 1, 1, 1)}
    scored = D.with_statistics(counts, counts).cache()
    assert {(r.term, r.df, r.cf) for r in scored.collect()} == {("a", 1, 2), ("b", 3, 3), ("c", 1, 1)}
    best = {r.id: r.term for r in D.best_terms(D.frequency_scores(scored, 5)).collect()}
    assert best == {0: "a", 1: "c", 2: "b"}
    out = {(r.id, r.term): r for r in D.enrichment(scored, 6).collect()}
    assert abs(out[0, "a"].log10_p - math.log10(exact_tail(2, 3, 2, 6))) < 1e-9
    p = sorted((float(exact_tail(r.tf, r.length, r.cf, 6)), t) for (i, t), r in out.items() if i == 0)
    adjusted = [min(1.0, *(q * len(p) / (j + 1) for j, (q, _) in enumerate(p) if j >= i)) for i in range(len(p))]
    assert all(abs(out[0, t].q - a) < 1e-9 for (_, t), a in zip(p, adjusted))
    assert D.term_counts(df.limit(0), "doc", "terms").count() == 0


def test_equal_scores_take_the_first_term(spark):
    df = spark.createDataFrame([(0, ["zz", "aa", "mm"]), (1, ["x"])], "id long, terms array<string>")
    counts = D.term_counts(df, "id", "terms")
    assert {r.id: r.term for r in D.best_terms(D.frequency_scores(D.with_statistics(counts, counts), 2)).collect()} == {0: "aa", 1: "x"}
