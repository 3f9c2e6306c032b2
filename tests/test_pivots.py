"""Exact nearest vectors around pivots against the full product."""

import logging

import numpy as np
import pytest

from lexigrove.operators import pivots


def frame(spark, rows, ids="long"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"id {ids}, vector array<double>")


def want(queries, docs, k):
    norm = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
    out = {}
    for q, v in queries:
        scores = [(-round(float(norm(v) @ norm(w)), 9) + 0.0, d) for d, w in docs if w is not None]
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def clustered(rng, n, centres=12, spread=0.05):
    own = rng.normal(size=(centres, 16))
    return [(i, own[i % centres] + spread * rng.normal(size=16)) for i in range(n)]


@pytest.mark.parametrize("many", [2, 60])
def test_nearest_like_the_full_product(spark, monkeypatch, caplog, many):
    monkeypatch.setattr(pivots, "PIVOTS", many)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(many)
    docs = clustered(rng, 600) + [(1000, np.zeros(16)), (1001, np.zeros(16)), (1002, None)] + [(2000 + k, np.ones(16)) for k in range(30)]
    queries = docs[::40] + [(5000, np.zeros(16)), (5001, -np.ones(16)), (5002, rng.normal(size=16))]
    queries = [q for q in queries if q[1] is not None]
    with caplog.at_level(logging.INFO, "lexigrove.operators.pivots"):
        got = pivots.dense_top(frame(spark, queries), frame(spark, docs), 7, doc_block=20).collect()
    mine = {q: [(d, s) for _, d, s in sorted((r["rank"], r.doc_id, round(r.score, 9) + 0.0) for r in got if r.query_id == q)] for q, _ in queries}
    full = want(queries, docs, 7)
    assert {q: [d for d, _ in x] for q, x in mine.items()} == {q: [d for d, _ in x] for q, x in full.items()}
    assert all(a == pytest.approx(b, abs=1e-8) for q in mine for (_, a), (_, b) in zip(mine[q], full[q], strict=True))
    skipped, total = caplog.records[-1].args
    assert many == 2 or skipped > total // 2  # blocks around many pivots are tight


def test_few_empty_and_other_ids(spark):
    docs = [("b", [1, 0]), ("a", [1, 0]), ("c", [0, 1])]
    got = pivots.dense_top(frame(spark, [("q", [1, 0])], "string"), frame(spark, docs, "string"), 5).collect()
    assert [(r.doc_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", 1), ("b", 2), ("c", 3)]
    none = frame(spark, [(1, [1.0, 0.0])]).limit(0)
    some = frame(spark, [(1, [1.0, 0.0])])
    assert pivots.dense_top(none, some).count() == 0 and pivots.dense_top(some, none).count() == 0
    zeros = frame(spark, [(k, [0, 0]) for k in range(5)])
    assert sorted((r.doc_id, r.score) for r in pivots.dense_top(some, zeros, 3).collect()) == [(0, 0.0), (1, 0.0), (2, 0.0)]
