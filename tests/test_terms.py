import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_data import DATA
from weftline.config import LsaConfig, TextConfig
from weftline.operators import blocks, dense, lda, lsa, ranking, similarity, tfidf, tvd
from weftline.plans import oracle, queries
from weftline.plans.pipeline import Workflow, batch, duplicate_workflow
from weftline.sinks import writers

DOCS = [(0, "apple banana banana"), (1, "apple cherry"), (2, "banana cherry cherry date")]
MU, MU_DO = TextConfig(single_terms=True), TextConfig(single_terms=True, single_document_terms=True)


def tf_of(spark, docs=DOCS):
    return tfidf.term_frequencies(tfidf.tokenise(spark.createDataFrame(docs, "idx long, doc string")))


def test_weights_and_similarities(spark):
    w = tfidf.weights(tf_of(spark), 3)
    got = {(r.idx, r.term): round(r.w, 6) for r in w.collect()}
    assert got == {(0, "apple"): 0.202733, (0, "banana"): 0.405465, (1, "apple"): 0.405465, (1, "cherry"): 0.405465, (2, "banana"): 0.202733, (2, "cherry"): 0.405465, (2, "date"): 0.549306}
    pairs = {(r.i, r.j): round(r.sim, 6) for r in similarity.similar_pairs(w, 0.01).collect()}
    assert pairs == {(0, 1): 0.316228, (0, 2): 0.254602, (1, 2): 0.402561}
    assert {(r.i, r.j) for r in similarity.similar_pairs(w, 0.4, both_directions=True).collect()} == {(1, 2), (2, 1)}


def test_pruning(spark):
    terms = lambda docs, c: {r.term for r in tfidf.pruned(tfidf.term_statistics(tf_of(spark, docs)), c).collect()}
    assert terms(DOCS, MU) == {"apple", "banana", "cherry"} == terms(DOCS, MU_DO)
    assert terms(DOCS, TextConfig(single_document_terms=True)) == {"apple", "banana", "cherry", "date"}
    more = DOCS + [(3, "fig fig")]
    assert "fig" in terms(more, MU) and "fig" not in terms(more, MU_DO)
    assert 3 not in {r.idx for r in tfidf.weights(tf_of(spark, more), 4, MU_DO).collect()}


def test_vocabulary_order(spark):
    v = tfidf.vocabulary(tfidf.tokenise(spark.createDataFrame(DOCS, "idx long, doc string")))
    assert [r.term for r in v.orderBy("term_idx").collect()] == ["apple", "banana", "cherry", "date"]
    assert tfidf.vocabulary_size(v).first()[0] == 4
    counts = tfidf.word_count_maps(tf_of(spark), v).filter("idx = 0").first()["counts"]
    assert counts == {0: 1, 1: 2}


def both_ranks(spark, rows):
    records = spark.createDataFrame(rows, "idx long, id string, duplicate_id string, doc string").cache()
    tf = tfidf.term_frequencies(tfidf.tokenise(records))
    units = similarity.normalised(tfidf.weights(tf, len(rows)))
    known = ranking.known_duplicates(records)
    a = ranking.duplicate_ranks(records, similarity.probe_similarities(units, known).withColumn("sim", F.round("sim", 9)), known)
    b = ranking.duplicate_ranks_of_vectors(records, units, known)
    return [{r.idx: (r.rank, round(r.sim, 6)) for r in x.collect()} for x in (a, b)]


def test_rank_of_a_known_duplicate(spark):
    rows = [(0, "a", "c", DOCS[0][1]), (1, "b", None, DOCS[1][1]), (2, "c", "", DOCS[2][1])]
    for ranks in both_ranks(spark, rows):
        assert ranks == {0: (2, 0.254602)}


def brute_ranks(rows):
    n = len(rows)
    tfs = [{t: d.split().count(t) for t in d.split()} for *_, d in rows]
    df = {t: sum(t in x for x in tfs) for x in tfs for t in x}
    ws = [{t: c / max(x.values()) * math.log(n / df[t]) for t, c in x.items()} for x in tfs]
    norm = [math.sqrt(sum(v * v for v in w.values())) for w in ws]
    sim = lambda i, j: round(sum(v * ws[j].get(t, 0) for t, v in ws[i].items()) / (norm[i] * norm[j]), 9) if norm[i] * norm[j] else 0.0
    out = {}
    for i, (_, rid, dup, _) in enumerate(rows):
        if dup and any(r[1] == dup for r in rows):
            order = sorted((j for j in range(n) if rows[j][1] != rid), key=lambda j: (-sim(i, j), j))
            places = [p for p, j in enumerate(order, 1) if rows[j][1] == dup]
            if places:
                out[i] = (places[0], round(sim(i, order[places[0] - 1]), 6))
    return out


def test_ranks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        doc = " ".join(rng.choice(words, rng.integers(0, 9)))
        dup = None if rng.random() < 0.3 else ("" if rng.random() < 0.1 else f"r{rng.integers(0, 55)}")
        rows.append((i, f"r{rng.integers(0, 50)}", dup, doc))
    expected = brute_ranks(rows)
    for ranks in both_ranks(spark, rows):
        assert ranks == expected


def test_hit_rates(spark):
    ranks = spark.createDataFrame([(1,), (10,), (11,), (25,)], "rank long")
    assert tuple(ranking.hit_rates(ranks).first()) == (4, 0.5, 0.75)
    assert ranking.hit_rates(ranks.limit(0)).first()["hit_10"] is None


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words[: 5 + i % 36], rng.integers(0, 12)))) for i in range(80)] + [(80, ""), (81, None)]
    w = tfidf.weights(tf_of(spark, docs), len(docs))
    vectors = {}
    for r in similarity.normalised(w).collect():
        vectors.setdefault(r.idx, {})[r.term] = r.u
    for cut in (0.2, 0.5, 0.9):
        expected = {(i, j) for i in vectors for j in vectors if i < j and sum(v * vectors[j].get(t, 0) for t, v in vectors[i].items()) > cut}
        assert {(r.i, r.j) for r in similarity.similar_pairs(w, cut).collect()} == expected


def test_pairs_of_many_tiles_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DENSE_TILE", 16)
    monkeypatch.setattr(blocks, "BATCH_BYTES", 4096)
    monkeypatch.setattr(blocks, "COMMON", 7)
    rng = np.random.default_rng(8)
    docs = [(i, " ".join([f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 14)) if x < 60])) for i in range(150)] + [(150, "")]
    w = tfidf.weights(tf_of(spark, docs), len(docs))
    vectors = {}
    for r in similarity.normalised(w).collect():
        vectors.setdefault(r.idx, {})[r.term] = r.u
    expected = {(i, j): sum(v * vectors[j].get(t, 0) for t, v in vectors[i].items()) for i in vectors for j in vectors if i < j}
    pairs = similarity.similar_pairs(w, 0.5)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = [((r.i, r.j), r.sim) for r in pairs.collect()]
    assert dict(found) == pytest.approx({k: v for k, v in expected.items() if v > 0.5}, abs=1e-12) and len(found) == len(dict(found))


def test_pairs_of_both_directions_are_made_once(spark):
    w = tfidf.weights(tf_of(spark), 3)
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx long, id string")
    rows = writers.pair_rows(similarity.similar_pairs(w, 0.4), ids, both_directions=True)
    assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ID_i, r.ID_j) for r in rows.collect()) == [("b", "c"), ("c", "b")]


def test_reduced_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DENSE_TILE", 16)
    monkeypatch.setattr(blocks, "BATCH_BYTES", 1000)
    v = np.random.default_rng(4).normal(size=(90, 3))
    found = blocks.pairs_above(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "idx int, coords array<double>"), 0.5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert sorted((r.i, r.j) for r in found.collect()) == [(i, j) for i in range(90) for j in range(i + 1, 90) if unit[i] @ unit[j] > 0.5]


@pytest.mark.parametrize("cut_off", [None, 0.3])
def test_products_of_pairs_are_not_shuffled(spark, monkeypatch, cut_off):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "BATCH_BYTES", 2000)
    rng, n = np.random.default_rng(6), 60
    full, asks, change = (rng.random((n, 30)) * (rng.random((n, 30)) < share) for share in (0.4, 0.3, 0.2))
    change -= 0.5 * (change > 0)
    row = lambda x: (np.flatnonzero(x).tolist(), x[x != 0].tolist())
    left = spark.createDataFrame([(i, *row(asks[i]), *row(change[i])) for i in range(n - 1)] + [(n - 1, None, None, None, None)], "idx int, t array<long>, u array<double>, ct array<long>, cu array<double>")
    norm2 = (full * full).sum(axis=1)
    right = spark.createDataFrame([(i, *row(full[i]), float(norm2[i])) for i in range(n)], "idx int, t array<long>, u array<double>, norm2 double")
    found = blocks.pair_products(left, right, cut_off)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    norms = np.sqrt(np.maximum(norm2[None, :] + change @ (full * full).T, 0))
    sims = np.divide(asks @ full.T, norms, out=np.zeros((n, n)), where=norms > 1e-12)
    expected = {(i, j): sims[i, j] for i in range(n) for j in range(i + 1, n) if cut_off is None or sims[i, j] > cut_off}
    assert {(r.i, r.j): r.sim for r in found.collect()} == pytest.approx(expected, abs=1e-12)


def test_two_records(spark):
    w = tfidf.weights(tf_of(spark), 3)
    ids = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, idx long")
    assert round(similarity.pair_similarity(w, ids, "a", "b").first()["sim"], 6) == 0.316228
    missing = similarity.pair_similarity(w, ids, "a", "nobody").first()
    assert missing["found"] is False and missing["sim"] is None
    v = {r.term: (round(r.vector_a, 6), round(r.vector_b, 6)) for r in tfidf.two_vectors(w, 0, 1).collect()}
    assert v == {"apple": (0.202733, 0.405465), "banana": (0.405465, 0.0), "cherry": (0.0, 0.405465)}


def low_rank(result):
    """The low-rank matrix in the order of idx and term."""
    docs = np.array([r["coords"] for r in result.documents.orderBy("idx").collect()])
    terms = np.array([r["coords"] for r in result.terms.orderBy("term").collect()])
    return docs @ (terms / np.array(result.values)).T


def test_full_rank_lsa_equals_weights(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["a1", "b2", "c3", "d4", "e5", "f6", "g7"], 6))) for i in range(12)]
    df = spark.createDataFrame(docs, "idx long, doc string")
    vocab = tfidf.vocabulary(tfidf.tokenise(df))
    w = tfidf.weights(tf_of(spark, docs), len(docs))
    result = lsa.lsa(w, vocab, LsaConfig(k=1700))
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(i)], "i long, j long")
    reduced = {(r.i, r.j): r.sim for r in lsa.pair_cosines(result.documents, pairs).collect()}
    exact = {(r.j, r.i): r.sim for r in similarity.similar_pairs(w, 1e-9).collect()}
    assert all(abs(s - exact.get(k, 0.0)) < 1e-6 for k, s in reduced.items())
    assert result.values == sorted(result.values, reverse=True)
    matrix = low_rank(lsa.lsa(w, vocab, LsaConfig(k=1)))
    assert np.linalg.matrix_rank(matrix, tol=1e-6) == 2  # one more than asked for
    terms = lsa.pair_cosines(result.terms.withColumnRenamed("term", "idx"), spark.createDataFrame([("a1", "a1")], "i string, j string"))
    assert abs(terms.first()["sim"] - 1) < 1e-9
    assert lsa.lsa(w.limit(0), vocab).values == []


def test_topics(spark):
    docs = [(i, "red green blue " * 3 if i % 2 else "cat dog bird " * 3) for i in range(12)]
    df = spark.createDataFrame(docs, "idx long, doc string")
    vocab, tf = tfidf.vocabulary(tfidf.tokenise(df)), tf_of(spark, docs)
    rows = lda.features(tf, vocab, 6)
    model = lda.fit(rows, 2, iterations=20)
    shares = lda.topic_shares(model, rows)
    assert all(abs(sum(r.theta) - 1) < 1e-9 and len(r.theta) == 2 for r in shares.collect())
    terms = lda.topic_terms(model, vocab)
    sums = terms.groupBy("topic").agg(F.sum("phi").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    assert 1 <= lda.perplexity(tf, lda.predicted_terms(shares, terms)).first()[0] <= 7
    same = lda.similarity(shares, spark.createDataFrame([(0, 2)], "i long, j long")).first()["sim"]
    assert same > 0.9
    again = lda.topic_shares(lda.fit(rows, 2, iterations=20), rows)
    assert np.allclose([r.theta for r in again.orderBy("idx").collect()], [r.theta for r in shares.orderBy("idx").collect()])
    assert lda.matched_topics(spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, 0)], "inferred int, true int")) == ({0: 1, 1: 0}, 3)


def test_topics_of_a_drawn_corpus(spark):
    theta, phi, tf = lda.synthetic_corpus(spark, 40, 12, 3)
    assert tf.groupBy("idx").agg(F.sum("tf").alias("n")).filter("n = 50").count() == 40
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(12)], "term string, term_idx int")
    named = tf.join(vocab, "term_idx").select("idx", "term", "tf")
    rows = lda.features(named, vocab, 12).cache()
    for k, model in lda.sweep(rows, (2, 3), iterations=5, optimizer="em"):
        assert all(len(r.theta) == k and abs(sum(r.theta) - 1) < 1e-9 for r in lda.topic_shares(model, rows).collect())
    unseen = lda.topic_shares(lda.fit(rows.filter("idx < 30"), 3, iterations=5), rows.filter("idx >= 30"))
    assert unseen.count() == 10 and theta.shape == (40, 3) and phi.shape == (3, 12)


def test_title_against_description(spark):
    full = [(0, "a b c d"), (1, "a b e"), (2, "c d f"), (3, "e f g")]
    short = [(0, "a b"), (1, "a e"), (2, "c"), (3, "g")]
    got = tvd.title_description_similarities(tf_of(spark, full), tf_of(spark, short), 4, spark.createDataFrame([(i,) for i in range(4)], "idx long"))
    got = {(r.q, r.c): round(r.sim, 9) for r in got.filter("sim > 0").collect()}
    expected = {}
    for q in range(4):  # the corpus rebuilt for each query
        docs = [d for _, d in full]
        docs[q] = short[q][1]
        tfs = [{t: d.split().count(t) for t in d.split()} for d in docs]
        df = {t: sum(t in x for x in tfs) for x in tfs for t in x}
        w = [{t: n / max(x.values()) * math.log(4 / df[t]) for t, n in x.items()} for x in tfs]
        norm = [math.sqrt(sum(v * v for v in x.values())) for x in w]
        for c in range(4):
            dot = sum(v * w[c].get(t, 0) for t, v in w[q].items())
            if c != q and dot > 0:
                expected[q, c] = round(dot / norm[q] / norm[c], 9)
    assert got == expected


def test_dense_cosine_and_neighbours(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    with pytest.raises(Exception, match="unequal length"):
        df.select(similarity.cosine(F.col("a"), F.array(F.lit(1.0)))).collect()
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 4)).round(3)
    rows = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)] + [(90, [0.0] * 4, 1), (91, None, 1)], "vec_id long, embedding array<double>, other int")
    got = {(r.q, r["rank"]): r.c for r in dense.nearest(rows, rows.filter("vec_id % 10 = 0"), "vec_id", "embedding", 3, block=2).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 50, 10):
        sims = unit @ unit[q]
        sims[q] = -9
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(-sims)[:3].tolist()


def test_workflow(spark):
    rows = [(i, str(i), f"{t} report", f"{t} is broken in the {w}", [t], None if i % 2 else str(i + 1)) for i, (t, w) in enumerate([("menu", "editor"), ("menu", "view"), ("cache", "server"), ("cache", "client"), ("font", "label"), ("font", "title")])]
    records = spark.createDataFrame(rows, "idx long, id string, title string, description string, comments array<string>, duplicate_id string")
    flow = duplicate_workflow(records, TextConfig(lower=True, stemming=True), LsaConfig(k=3))
    assert tuple(flow.get("rates").first()) == (3, 1.0, 1.0) == tuple(flow.get("lsa_rates").first())
    assert {r["rank"] for r in flow.get("ranks").collect()} == {1} == {r["rank"] for r in flow.get("lsa_ranks").collect()}
    assert flow.get("weights") is flow.get("weights") and flow.get("pairs").count() >= 3
    flow.register("rates", lambda ranks: ranks.count())
    assert flow.get("rates") == 3
    with pytest.raises(KeyError):
        flow.get("nothing")
    with pytest.raises(ValueError):
        Workflow().register("a", lambda b: b).register("b", lambda a: a).get("a")
    runs = batch(records, [TextConfig(lower=True), TextConfig(all_comments=True, double_title=True)])
    assert [r.suffix for r in runs.collect()] == ["_LO", "_AC_DW"]


def test_reduced_pairs_against_brute_force(spark, duck, monkeypatch):
    from tests_data import DATA
    from weftline.operators import blocks
    from weftline.plans import queries

    monkeypatch.setattr(blocks, "DENSE_TILE", 16)  # several tiles
    rng = np.random.default_rng(3)
    v = rng.normal(size=(70, 3))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, [0.0] * 3)], "idx int, coords array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    expected = {(i, j): (unit @ unit.T)[i, j] for i in range(70) for j in range(i + 1, 70) if (unit @ unit.T)[i, j] > 0.5}
    found = blocks.pairs_above(rows, 0.5)
    got = {(r.i, r.j): r.sim for r in found.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - s) < 1e-9 for k, s in expected.items()) and found.schema["i"].dataType.simpleString() == "int"
    assert blocks.pairs_above(rows.limit(0), 0.5).count() == 0
    kept = {}
    monkeypatch.setattr(queries.lsa, "lsa", lambda *a, _f=lsa.lsa: kept.setdefault("model", _f(*a)))
    pairs = {(r.i, r.j) for r in queries.h5_lsa_pairs(spark, str(DATA)).collect()}
    docs = {r.idx: np.array(r.coords) for r in kept["model"].documents.collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert pairs == {(i, j) for i in docs for j in docs if i < j and docs[i].any() and docs[j].any() and cos(docs[i], docs[j]) > 0.5}


def test_topics_are_fitted_to_all_records(spark, duck, monkeypatch):
    from tests_data import DATA
    from weftline.plans import queries

    kept = {}
    real = lda.fit

    def fit(rows, *args, **options):
        kept["rows"], kept["model"] = rows, real(rows, *args, **options)
        return kept["model"]

    monkeypatch.setattr(lda, "fit", fit)
    assert queries.h15_topics(spark, str(DATA)).count() == kept["rows"].count()
    counts = sum(r.features.toArray() for r in kept["rows"].collect())
    assert np.allclose(kept["model"].topicsMatrix().toArray().sum(axis=1), counts)  # every word of every record is evidence
    assert lda.mini_batches(10_000) == 500 and lda.mini_batches(0) == 5


def test_ratio_rule_keeps_all_values_that_meet_it(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice([f"t{n}" for n in range(30)], 9))) for i in range(20)]
    vocab = tfidf.vocabulary(tfidf.tokenise(spark.createDataFrame(docs, "idx long, doc string")))
    w = tfidf.weights(tf_of(spark, docs), len(docs)).cache()
    matrix = np.zeros((20, vocab.count()))
    place = {r.term: r.term_idx for r in vocab.collect()}
    for r in w.collect():
        matrix[r.idx, place[r.term]] = r.w
    s = np.linalg.svd(matrix, compute_uv=False)
    monkeypatch.setattr(lsa, "SLICE_BYTES", 8 * 20 * 3)
    for config, n in ((LsaConfig(ratio=0.4, largest=2), int((s / s[0] >= 0.4).sum())), (LsaConfig(largest=2), int((s / s[0] >= 0.04).sum())), (LsaConfig(k=-1, largest=2), 20)):
        result = lsa.lsa(w, vocab, config)
        assert n > 2 and np.allclose(result.values, s[:n])
        coords = np.array([r.coords for r in result.documents.orderBy("idx").collect()])
        assert np.allclose(np.linalg.norm(coords, axis=0), s[:n])


@pytest.mark.parametrize("n_docs,n_terms", [(60, 25), (25, 60)])
@pytest.mark.parametrize("limit", [0, 8192])
def test_both_solvers_and_orientations(spark, monkeypatch, n_docs, n_terms, limit):
    """Against numpy: values, and the products of coordinates, which no sign or rotation changes."""
    monkeypatch.setattr(lsa, "GRAM_LIMIT", limit or 1)
    monkeypatch.setattr(lsa, "PANEL", 8)
    if limit == 0:
        monkeypatch.setattr(lsa, "_exact", None)
    rng = np.random.default_rng(8)
    dense = np.where(rng.random((n_docs, n_terms)) < 0.3, rng.random((n_docs, n_terms)), 0.0)
    dense[3] = 0.0
    w = spark.createDataFrame([(int(i), f"t{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))], "idx int, term string, w double")
    vocab = spark.createDataFrame([(f"t{j}", j) for j in range(n_terms)], "term string, term_idx int")
    u, s, vt = np.linalg.svd(dense)
    for k, config in ((5, LsaConfig(k=5, one_more=False)), (6, LsaConfig(k=5)), (int((s / s[0] >= 0.2).sum()), LsaConfig(ratio=0.2, largest=4)), (len(s) - (n_docs < n_terms), LsaConfig(k=-1, largest=4))):
        result = lsa.lsa(w, vocab, config)
        assert np.allclose(result.values, s[:k], atol=1e-7)
        docs = {r.idx: np.array(r.coords) for r in result.documents.collect()}
        terms = {r.term: np.array(r.coords) for r in result.terms.collect()}
        assert set(docs) == set(range(n_docs)) - {3} and set(terms) == {f"t{j}" for j in range(n_terms)}
        a, b = u[:, :k] * s[:k], vt[:k].T * s[:k]
        for i, j in ((0, 1), (2, 5), (7, 7)):
            assert abs(docs[i] @ docs[j] - a[i] @ a[j]) < 1e-6 and abs(terms[f"t{i}"] @ terms[f"t{j}"] - b[i] @ b[j]) < 1e-6


def test_basis_that_does_not_fit_is_refused(spark, monkeypatch):
    monkeypatch.setattr(lsa, "GRAM_LIMIT", 1)
    monkeypatch.setattr(lsa, "BASIS_BYTES", 100)
    w = spark.createDataFrame([(i, f"t{i % 3}", 1.0 + i) for i in range(6)], "idx int, term string, w double")
    with pytest.raises(MemoryError):
        lsa.lsa(w, spark.createDataFrame([("t0", 0), ("t1", 1), ("t2", 2)], "term string, term_idx int"), LsaConfig(k=2))


def test_whole_table_of_titles_against_descriptions(spark, duck, monkeypatch):
    from tests_data import DATA
    from weftline.operators import blocks
    from weftline.plans import queries

    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "TILE", 32)
    r = queries.records(spark, str(DATA)).select("idx").cache()
    full, short = queries._tf(spark, str(DATA), TextConfig(lower=True, all_comments=True)), queries._tf(spark, str(DATA))
    expected = {(x.q, x.c): x.sim for x in tvd.title_description_similarities(full, short, r.count(), r).filter("q < c").collect()}
    rows = queries.b3_title_description_pairs(spark, str(DATA)).collect()
    got = {(x.i, x.j): x.sim for x in rows}
    n = r.count()
    assert len(rows) == len(got) == n * (n - 1) // 2
    assert all(abs(s - expected.get(k, 0.0)) < 1e-9 for k, s in got.items()) and set(expected) <= set(got)


def test_topic_sweep_does_the_published_iterations(spark, monkeypatch):
    asked, real = [], lda.LDA
    monkeypatch.setattr(lda, "LDA", lambda **options: asked.append((options["k"], options["maxIter"])) or real(**options | {"maxIter": 1}))
    queries.h17_topic_sweep(spark, str(DATA))
    assert asked == [(k, 50) for k in range(100, 201, 10)]


def test_wanted_documents_meet_only_queries_that_want_them():
    seen = []
    similarity_ = blocks.Similarity(lambda t: t.num_rows, lambda t: t.num_rows, lambda q, d: seen.append((q, d)) or np.full((q, d), 0.5))
    asked = pa.table({"idx": range(600), "key": range(600), "wanted": [1000] + [2000] * 599})
    out = list(blocks._hits(asked, pa.table({"idx": [1000, 1001], "key": [1000, 1001]}), similarity_))
    assert seen == [(1, 2)] and [b.to_pylist() for b in out] == [[{"idx": 0, "c": 1000, "sim": 0.5}]]


@pytest.mark.parametrize("name", ["h10_full_rank_pairs", "h12_full_rank_terms"])
def test_full_rank_needs_no_decomposition(same_as_sql, monkeypatch, name):
    monkeypatch.setattr(lsa, "lsa", lambda *a: pytest.fail("decomposed"))
    same_as_sql(queries.QUERIES[name], oracle.SQL[name])


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_all_values_are_found_without_directions(spark, monkeypatch, pairs):
    for name in ("_exact", "_krylov", "_projected"):
        monkeypatch.setattr(lsa, name, lambda *a: pytest.fail("directions were computed"))
    rng = np.random.default_rng(2)
    dense = np.round(rng.random((12, 9)) * (rng.random((12, 9)) < 0.5), 3)
    dense[0] = np.arange(1, 10)
    entries = [(i, f"t{j}", float(dense[i, j])) for i in range(12) for j in range(9) if dense[i, j]]
    w = spark.createDataFrame(entries, "idx int, term string, w double")
    vocab = spark.createDataFrame([(f"t{j}", j) for j in range(9)], "term string, term_idx int")
    assert np.allclose(lsa.lsa(w, vocab, LsaConfig(k=-1)).values, np.linalg.svd(dense)[1], atol=1e-7)
    c = pa.ListArray.from_arrays(pa.array([0, 0, 3, 4], pa.int32()), pa.array([0, 2, 3, 1], pa.int32()))
    batch = pa.RecordBatch.from_arrays([c, pa.ListArray.from_arrays(c.offsets, pa.array([1.0, 2.0, 3.0, 4.0]))], names=["c", "w"])
    monkeypatch.setattr(lsa, "PAIRS", pairs)
    for b in (batch, batch.slice(1, 2)):
        products = lsa._half_used(4)
        lsa._add_products(products, b)
        assert products.tolist() == [[1, 0, 2, 3], [0, 16, 0, 0], [0, 0, 4, 6], [0, 0, 0, 9]]
        assert np.allclose(lsa._eigenvalues(products), [0, 0, 14, 16])


@pytest.mark.parametrize("name", ["g7_singular_values", "h13_count_matrix_values"])
def test_values_alone_need_no_coordinates(same_as_sql, monkeypatch, name):
    monkeypatch.setattr(lsa, "_projected", lambda *a: pytest.fail("coordinates were computed"))
    same_as_sql(queries.QUERIES[name], oracle.SQL[name])


@pytest.mark.parametrize("share", [0.0, 0.4, 9.0])
def test_topic_shares_of_a_task_are_those_of_expectation_maximisation(monkeypatch, share):
    monkeypatch.setattr(lda, "SHARE", share)
    monkeypatch.setattr(lda, "DOCUMENTS", 7)
    monkeypatch.setattr(lda, "ENTRIES", 5)
    rng, k, alpha, beta = np.random.default_rng(4), 3, 1.5, 0.1
    counts = rng.integers(1, 4, (20, 9)) * (rng.random((20, 9)) < 0.4)
    counts[5] = 0
    d, c = np.nonzero(counts)
    ends = np.cumsum((counts > 0).sum(axis=1))

    def run(iterations):
        return lda.em_shares(ends, c.astype(np.int32), counts[d, c].astype(float), 9, k, iterations, alpha, beta, 5)

    draws = np.random.default_rng([5, k])
    of_documents, of_terms = draws.random((20, k)), draws.random((9, k))
    of_documents *= (counts.sum(axis=1) / of_documents.sum(axis=1))[:, None]
    of_terms *= (counts.sum(axis=0) / of_terms.sum(axis=1))[:, None]
    for _ in range(4):
        gamma = (of_documents[:, None, :] + alpha) * (of_terms[None, :, :] + beta) / (of_terms.sum(axis=0) + 9 * beta)
        gamma *= (counts / gamma.sum(axis=2))[:, :, None]
        of_documents, of_terms = gamma.sum(axis=1), gamma.sum(axis=0)
    expected = (of_documents + alpha) / (of_documents + alpha).sum(axis=1, keepdims=True)
    assert np.allclose(run(4), expected) and np.allclose(run(4)[5], 1 / k) and not np.allclose(run(3), expected)


def test_models_of_a_sweep_are_fitted_side_by_side(spark, monkeypatch):
    def fit(self, rows):
        pytest.fail("fitted one after the other")

    real = lda.LDA
    monkeypatch.setattr(lda, "LDA", lambda **options: real(**options | {"maxIter": 2}))
    monkeypatch.setattr(real, "fit", fit)
    rows = queries.h17_topic_sweep(spark, str(DATA)).collect()
    assert [r.topics for r in rows] == list(range(100, 201, 10)) and len({r.n_duplicates for r in rows}) == 1 and rows[0].n_duplicates > 0
