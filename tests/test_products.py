"""Pruned products, ranks by counting and the threshold algorithm against full products."""

import logging
import random
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrove import store
from lexigrove.functions import text as tx
from lexigrove.operators import fusion, products, retrieval


def leg_of(spark, queries, docs):
    """A leg from {id: {term: weight}} of both sides, with scales 1, 2, 3 and 4 by document."""
    q = spark.createDataFrame([(i, t, w, 2.0) for i, v in queries.items() for t, w in v.items()], "query_id long, term string, weight double, factor double")
    d = spark.createDataFrame([(i, t, w) for i, v in docs.items() for t, w in v.items()], "doc_id long, term string, weight double")
    scales = spark.createDataFrame([(i, 1.0 + i % 4) for i in docs], "doc_id long, scale double")
    return products.Leg(q, d, scales, lambda w, s: w / s)


def full_of(queries, docs):
    """{query: {doc: score}} of the pairs with a common term."""
    return {q: {d: sum(v[t] * w[t] * 2.0 / (1.0 + d % 4) for t in v if t in w) for d, w in docs.items() if v.keys() & w.keys()} for q, v in queries.items()}


def random_sides(rng, n_docs, n_queries, signed=False):
    """Words of unlike frequency; documents that repeat; scores of 0 and, if ``signed``, below."""
    words = [f"w{k}" for k in range(60)]
    pick = lambda n: {words[min(59, int(rng.expovariate(0.12)))]: rng.choice([0.5, 1.0, rng.random()]) for _ in range(n)}
    some = [pick(rng.randint(1, 12)) for _ in range(n_docs // 2)]
    docs = {3 * i + 1: dict(rng.choice(some)) for i in range(n_docs)}
    queries = {q: pick(rng.randint(1, 8)) for q in range(n_queries)}
    if signed:
        queries = {q: {t: w * rng.choice([1, -1, 0]) for t, w in v.items()} for q, v in queries.items()}
    return queries, docs


def first(scores, k):
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.mark.parametrize("signed", [False, True])
def test_best_are_those_of_the_full_product(spark, monkeypatch, signed):
    monkeypatch.setattr(products, "CELLS", 600)
    monkeypatch.setattr(products, "ENTRIES", 150)
    rng = random.Random(signed)
    queries, docs = random_sides(rng, 400, 25, signed)
    want = full_of(queries, docs)
    for held in (1 << 20, 40):
        monkeypatch.setattr(products, "HELD", held)
        got = retrieval.top(products.best(leg_of(spark, queries, docs), 7), 7).collect()
        for q in queries:
            mine = sorted((r["rank"], r.doc_id, round(r.score, 9)) for r in got if r.query_id == q)
            assert [(d, s) for _, d, s in mine] == [(d, round(s, 9)) for d, s in first(want[q], 7)]


def test_chunks_are_skipped_and_rows_are_few(spark):
    """What leaves a task is bounded by k, and chunks that cannot hold a better document are not scored."""
    rng = random.Random(3)
    queries = {q: {f"own{q}": 5.0, "the": 0.1, "of": 0.1} for q in range(20)}
    docs = {i: {"the": 1.0, "of": rng.random(), f"x{i}": 1.0} | ({f"own{i % 20}": 1.0} if i < 400 else {}) for i in range(4000)}
    leg = leg_of(spark, queries, docs)
    held = next(products.groups(leg))
    number = {t: k for k, t in enumerate(held.terms.to_pylist())}
    rows = [(i, -1, 1.0) for i in docs] + [(i, number[t], w * 2) for i, v in docs.items() for t, w in v.items() if t in number]
    rows.sort(key=lambda r: r[:2])
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*rows, strict=True)], ["doc_id", "t", "w"])
    state = products.Best(held, 5)
    for k in range(0, len(rows), 1000):
        for chunk in products.chunks(iter([batch.slice(k, 1000)]), held, lambda w, s: w / s):
            state.add(chunk)
    assert state.skipped > state.seen // 2 and len(state.q) == 100
    with store.scratch(spark):
        assert products.best(leg, 5).count() <= 5 * 20 * spark.sparkContext.defaultParallelism


def full_ranks(scores, docs):
    order = sorted(docs, key=lambda d: (-round(scores.get(d, 0.0), 9), d))
    return {d: k + 1 for k, d in enumerate(order)}


@pytest.mark.parametrize("signed", [False, True])
def test_ranks_are_counted(spark, monkeypatch, signed):
    monkeypatch.setattr(products, "CELLS", 600)
    rng = random.Random(10 + signed)
    queries, docs = random_sides(rng, 150, 10, signed)
    docs |= {1000 + k: {"none": 1.0} for k in range(20)}
    queries[99] = {}
    scores = full_of(queries, docs)
    ids = spark.createDataFrame([(d,) for d in docs], "doc_id long")
    pairs = [(q, d) for q in queries for d in rng.sample(sorted(docs), 40)]
    for held in (1 << 20, 20):
        monkeypatch.setattr(products, "HELD", held)
        got = products.ranks_of(leg_of(spark, queries, docs), spark.createDataFrame(pairs, "query_id long, doc_id long"), retrieval.places(ids), len(docs)).collect()
        want = {q: full_ranks(scores[q], docs) for q in queries}
        assert {(r.query_id, r.doc_id): r["rank"] for r in got} == {(q, d): want[q][d] for q, d in pairs}


def fused_of(legs, weights, docs, q, n, digits):
    ranks = {name: full_ranks(scores[q], docs) for name, scores in legs.items()}
    score = {d: sum(w / (60 + ranks[name][d]) for name, w in weights.items()) for d in docs}
    return sorted(((round(s, digits), d) for d, s in score.items()), key=lambda x: (-x[0], x[1]))[:n]


@pytest.mark.parametrize("signed", [False, True])
def test_fusion_stops_early_and_is_exact(spark, monkeypatch, caplog, signed):
    """One query meets all documents, one none; legs that disagree need more rounds."""
    rng = random.Random(20 + signed)
    words, docs = random_sides(rng, 300, 8, signed)
    others, chars = random_sides(rng, 300, 8)
    queries = {q: words[q] for q in words} | {50: {}, 51: {"all": 1.0}}
    others |= {50: {}, 51: {"w1": 0.1}}
    docs = {d: v | {"all": 0.5} for d, v in docs.items()}
    legs = {"a": (queries, docs), "b": (others, chars)}
    weights = {"a": 3.0, "b": 1.0}
    full = {name: full_of(*sides) for name, sides in legs.items()}
    asked = spark.createDataFrame([(q,) for q in queries], "query_id long")
    ids = spark.createDataFrame([(d,) for d in docs], "doc_id long")
    made = {name: leg_of(spark, *sides) for name, sides in legs.items()}
    with caplog.at_level(logging.INFO, "lexigrove.operators.fusion"):
        got = fusion.best_fused(made, weights, asked, ids, 5, depth=20).collect()
    for q in queries:
        mine = sorted((r["rank"], round(r.score, 15), r.doc_id) for r in got if r.query_id == q)
        assert [x[1:] for x in mine] == [(pytest.approx(s, abs=1e-14), d) for s, d in fused_of(full, weights, docs, q, 5, 15)]
    depths = [r.args[0] for r in caplog.records]
    assert depths == [300] if signed else depths[0] == 20 and depths == sorted(depths)


def test_legs_that_agree_are_read_to_the_first_depth_only(spark, caplog):
    docs = {d: {"x": 1.0 + d % 4, f"t{d}": 1.0} for d in range(500)}
    queries = {q: {f"t{d}": 100.0 - d for d in range(q, q + 80)} for q in range(4)}
    leg = leg_of(spark, queries, docs)
    ids, asked = spark.createDataFrame([(d,) for d in docs], "doc_id long"), spark.createDataFrame([(q,) for q in queries], "query_id long")
    with caplog.at_level(logging.INFO, "lexigrove.operators.fusion"):
        got = fusion.best_fused({"a": leg, "b": leg}, {"a": 1.0, "b": 1.0}, asked, ids, 10).collect()
    assert [r.args for r in caplog.records] == [(64, 0)] and len(got) == 40
    full = full_of(queries, docs)
    for q in queries:
        assert [d for _, d in sorted((r["rank"], r.doc_id) for r in got if r.query_id == q)] == [d for _, d in fused_of({"a": full, "b": full}, {"a": 1.0, "b": 1.0}, docs, q, 10, 15)]


def test_no_plan_has_a_window_over_all_documents_of_a_query(spark):
    """One query and every document: the ranks come from counts a task."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word "), F.col("id").cast("string")).alias("coarse_text"))
    queries = spark.createDataFrame([(1, "common word 17")], "query_id long, text string")
    from lexigrove.plans import ranking as plan

    got = plan.stage1(queries, docs, plan.Config(n_candidates=5)).orderBy("rank").collect()
    assert got[0].doc_id == 17 and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_legs_of_texts_agree_with_pair_scores(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "the", "of", "tariff", "code"]) for _ in range(rng.randint(0, 9)))
    docs = spark.createDataFrame([(f"R{i:03d}", text()) for i in range(80)], "doc_id string, text string")
    queries = spark.createDataFrame([(f"D{i}", text()) for i in range(9)], "query_id string, text string")
    terms = lambda frame, key: retrieval.postings(frame, key, tx.tokenise(F.col("text")))
    for make in (retrieval.tfidf_leg, retrieval.bm25_leg):
        leg = make(terms(queries, "query_id"), terms(docs, "doc_id"), retrieval.corpus_size(docs))
        want = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in retrieval.top(retrieval.pair_scores(leg), 6).collect()}
        assert {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in retrieval.top(products.best(leg, 6), 6).collect()} == want
    empty = retrieval.tfidf_leg(terms(queries.limit(0), "query_id"), terms(docs, "doc_id"), retrieval.corpus_size(docs))
    assert products.best(empty, 3).count() == 0
    none = retrieval.tfidf_leg(terms(queries, "query_id"), terms(docs.limit(0), "doc_id"), retrieval.corpus_size(docs.limit(0)))
    assert reduce(lambda a, b: a + b, [products.best(none, 3).count()]) == 0


def test_long_documents_are_scored_as_matrices(spark, monkeypatch):
    """Many documents at once where each has much in common with the queries, and the same scores as by entries."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    queries = {q: {w: rng.random() for w in rng.sample(words, 150)} for q in range(60)}
    docs = {i: {w: rng.random() for w in rng.sample(words, 200)} for i in range(500)}
    held = next(products.groups(leg_of(spark, queries, docs)))
    number = {t: k for k, t in enumerate(held.terms.to_pylist())}
    own, doc, t = np.array(list(docs)), np.repeat(np.arange(500), 200), np.array([number[w] for v in docs.values() for w in v])
    w = np.array([x for v in docs.values() for x in v.values()])
    found = {}
    for table in (products.TABLE, 0):
        monkeypatch.setattr(products, "TABLE", table)
        made = list(products._parted(own, doc, t, w, held))
        state = products.Best(held, 7)
        for chunk in made:
            state.add(chunk)
        found[table] = len(made), np.concatenate([c.products(held) for c in made]), sorted(zip(state.q, state.doc, state.score.round(9), strict=True))
    matrices, entries = found.values()
    assert matrices[0] == 1 and entries[0] > 1
    assert np.allclose(matrices[1], entries[1], rtol=1e-12, atol=0) and matrices[2] == entries[2]


@pytest.mark.parametrize("weights", [{"word": 1.0}, {"char": 3.0, "word": 1.0}])
def test_dense_fusion_holds_no_query_in_a_task(spark, monkeypatch, weights):
    """With a dense leg every pair has a rank, and only the last choice of a few is a window of a query."""
    from lexigrove.plans import ranking as plan

    from lexigrove.plans import ranking as plan

    monkeypatch.setattr(store, "PAIR_ROWS", 40)
    rng = random.Random(3)
    texts = {d: " ".join(rng.choice(["red", "bolt", "ring", "steel", f"n{d % 7}"]) for _ in range(3)) for d in range(120)}
    asked = {1: "red n3 steel", 2: "bolt ring", 3: "nothing of it"}
    near = {(q, d): float((q * d * 7919) % 11) for q in asked for d in texts}
    docs, queries = spark.createDataFrame(list(texts.items()), "doc_id long, coarse_text string"), spark.createDataFrame(list(asked.items()), "query_id long, text string")
    dense = spark.createDataFrame([(q, d, s) for (q, d), s in near.items()], "query_id long, doc_id long, score double")
    found = plan.stage1(queries, docs, plan.Config(weights=weights), dense).where("rank <= 7")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    got = {(r.query_id, r["rank"]): r.doc_id for r in found.collect()}

    def placed(scores, digits=9):
        out = {}
        for q in asked:
            out |= {(q, d): k for k, d in enumerate(sorted(texts, key=lambda d: (-round(scores.get((q, d), 0.0), digits), d)), 1)}
        return out

    legs = {name: placed({(r.query_id, r.doc_id): r.score for r in retrieval.pair_scores(leg).collect()}) for name, leg in plan.legs(queries, docs, list(weights)).items()}
    first = placed({p: sum(w / (60 + legs[name][p]) for name, w in weights.items()) for p in near}, 15)
    second = placed(near)
    want = placed({p: 1 / (60 + first[p]) + 0.5 / (60 + second[p]) for p in near}, 15)
    assert got == {(q, k): d for (q, d), k in want.items() if k <= 7}


@pytest.mark.parametrize("thick", [0.0, 0.7, 1e9])
def test_columns_of_matrices_are_the_terms_of_many_products(spark, monkeypatch, thick):
    """Rare terms stay entries beside a matrix; scores and common terms are the same with all, some or none as columns."""
    monkeypatch.setattr(products, "THICK", thick)
    rng = random.Random(13)
    words = [f"w{k}" for k in range(80)]
    queries = {q: {w: rng.choice([0.0, rng.random()]) for w in words if rng.random() < 4 / (1 + int(w[1:]))} | {"all": 1.0} for q in range(12)}
    docs = {i: {w: rng.random() for w in words if rng.random() < 9 / (1 + int(w[1:]))} for i in range(90)}
    held = next(products.groups(leg_of(spark, queries, docs)))
    number = {t: k for k, t in enumerate(held.terms.to_pylist())}
    rows = [(i, number[w], x) for i, v in docs.items() for w, x in v.items() if w in number]
    doc, t, w = (np.array(c) for c in zip(*rows, strict=True))
    chunk, touched = products.Chunk(np.arange(90), doc, t, w, True), np.zeros((90, 12), bool)
    made = chunk.products(held, touched=touched)
    for k, q in enumerate(held.ids.to_pylist()):
        assert np.allclose(made[:, k], [sum(x * docs[i][v] for v, x in queries[q].items() if v in docs[i]) for i in range(90)], rtol=1e-12, atol=1e-15)
        assert touched[:, k].tolist() == [bool(queries[q].keys() & docs[i].keys()) for i in range(90)]
    own = np.array([3, 50])
    assert np.allclose(chunk.products(held, only=own), made[own], rtol=1e-12, atol=1e-15)
