import csv
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import evaluate, fusion, retrieval
from lexigrove.operators.scorers import LexicalScorer, ModelScorer, TableScorer, model_folder
from lexigrove.plans import ranking as plan
from lexigrove.sources import files


def test_rrf_and_lexical_only(spark):
    leg = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.score for r in fusion.rrf([(leg, 1.0), (leg, 2.0)]).collect()}
    assert got[10] == pytest.approx(3 / 61) and got[11] == pytest.approx(3 / 62)
    candidates = spark.createDataFrame([(1, d, d) for d in range(5)], "query_id long, doc_id long, cand_pos long")
    final = {r.cand_pos: r.score for r in fusion.rerank(candidates, None).collect()}
    assert all(final[p] == pytest.approx(61 / (61 + p)) for p in range(5))


def test_clamp(spark):
    rows = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate([1.0, 1.0, 0.9, 0.9])], "query_id long, rank long, score double")
    got = [r.score for r in fusion.clamp(rows).orderBy("rank").collect()]
    assert got == pytest.approx([1.0, 0.999999999, 0.9, 0.899999999], abs=1e-12) and all(a > b for a, b in zip(got, got[1:], strict=False))


def test_bm25_floor(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a c c")], "id long, text string")
    d = retrieval.postings(docs, "id", F.split("text", " "))
    q = retrieval.postings(spark.createDataFrame([(9, "a c a")], "id long, text string"), "id", F.split("text", " "))
    got = {r.doc_id: r.score for r in retrieval.pair_scores(retrieval.bm25_leg(q, d, retrieval.corpus_size(docs))).collect()}
    raw = {"a": math.log(0.5) - math.log(3.5), "b": math.log(2.5) - math.log(1.5), "c": math.log(2.5) - math.log(1.5)}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / 3 for t, v in raw.items()}
    part = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    assert got[3] == pytest.approx(2 * part("a", 1, 3) + part("c", 2, 3)) and got[2] == pytest.approx(2 * part("a", 1, 1))


def catalogue(spark):
    docs = [(1, "труба стальная", "труба стальная более 5 мм"), (2, "труба медная", "труба медная не более 5 мм"), (3, "колесо", "колесо")]
    docs = spark.createDataFrame(docs, "doc_id long, coarse_text string, disc_text string").withColumn("fine_text", F.col("coarse_text"))
    queries = spark.createDataFrame([(1, "труба 3 мм"), (2, "колесо мебельное")], "query_id long, text string").withColumn("coarse_text", F.col("text"))
    return queries, docs


def test_plan(spark):
    queries, docs = catalogue(spark)
    config = plan.Config(n_candidates=3, top_k=3, constraint_weight=0.5)
    got = {(r.query_id, r["rank"]): r for r in plan.rank(queries, docs, config, LexicalScorer()).collect()}
    assert len(got) == 6 and got[2, 1].doc_id == 3 and got[1, 1].doc_id == 2
    assert all(got[q, k].score > got[q, k + 1].score for q in (1, 2) for k in (1, 2))
    scores = spark.createDataFrame([(1, 1, 9.0), (1, 2, 1.0), (1, 3, 0.0), (2, 1, 0.0), (2, 2, 0.0), (2, 3, 5.0)], "query_id long, doc_id long, score double")
    first = plan.rank(queries, docs, plan.Config(n_candidates=3, ce_weight=5.0), TableScorer(scores)).where("rank = 1").collect()
    assert {r.query_id: r.doc_id for r in first} == {1: 1, 2: 3}


def test_model_scorer(spark):
    pairs = spark.createDataFrame([(1, 2, "ab", "abc")], "query_id long, doc_id long, query_text string, doc_text string")
    load = lambda folder: lambda qs, ds: [float(len(q) + len(d)) for q, d in zip(qs, ds, strict=True)]
    assert ModelScorer(load, "").score(pairs).first().score == 5.0
    with pytest.raises(Exception, match="not finite"):
        ModelScorer(lambda folder: lambda qs, ds: [float("nan")] * len(qs), "").score(pairs).collect()
    with pytest.raises(FileNotFoundError):
        model_folder("m", "/nonexistent/lock.json", "/nonexistent")


def test_stream(spark, tmp_path):
    from lexigrove.streaming.ranking import rank_stream

    queries, docs = catalogue(spark)
    queries.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = rank_stream(spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in")), docs, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    stream.awaitTermination(120)
    assert len(seen) == 6


def test_metrics_and_wilson(spark):
    gold = spark.createDataFrame([(f"D{i}", "R1") for i in range(120)], "declaration_id string, regulation_id string")
    ranking = spark.createDataFrame([(f"D{i}", "R1", 1 if i < 94 else 2 if i < 110 else 4) for i in range(119)], "declaration_id string, regulation_id string, rank int")
    got = evaluate.report(ranking, gold).first()
    assert got.n == 120 and got.hit1 == pytest.approx(94 / 120) and got.hit3 == pytest.approx(110 / 120) and got.hit5 == pytest.approx(119 / 120)
    assert got.hit1_low == pytest.approx(0.70145, abs=1e-5) and got.hit1_high == pytest.approx(0.84763, abs=1e-5)


def test_gate(spark):
    rows = [("D1", k, f"R{k}", 1.0 - k / 100) for k in range(1, 11)] + [("D2", k, "R1" if k > 8 else f"R{k}", 2.0 if k == 3 else float("nan") if k == 5 else 1.0) for k in range(1, 10)] + [("D9", 1, "X", 1.0)]
    ranking = spark.createDataFrame(rows, "declaration_id string, rank int, regulation_id string, score double")
    queries = spark.createDataFrame([("D1",), ("D2",), ("D3",)], "declaration_id string")
    docs = spark.createDataFrame([(f"R{k}",) for k in range(1, 11)], "regulation_id string")
    said = {(r.rule, r.declaration_id) for r in evaluate.violations(ranking, queries, docs).collect()}
    assert said >= {("unknown_declaration", "D9"), ("absent_declaration", "D3"), ("row_count", "D2"), ("ranks", "D2"), ("duplicate_regulation", "D2"), ("unknown_regulation", "D9"), ("not_finite", "D2"), ("rising_score", "D2")}
    assert not [x for x in said if x[1] == "D1"]
    assert evaluate.violations(ranking.drop("score"), queries, docs).first().rule == "columns"
    assert "empty" in {r.rule for r in evaluate.violations(ranking.limit(0), queries, docs).collect()}


def test_files(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"declaration_id": "D2", "G31_1": " a ", "desc_extention": null}\n\n{"declaration_id": "D1", "G31_1": "b", "desc_extention": "c"}\n', encoding="utf-8")
    rows = files.declarations(spark, str(tmp_path / "d.jsonl")).orderBy("input_ord").collect()
    assert [(r.declaration_id, r.text) for r in rows] == [("D2", "a"), ("D1", "b. c")]
    ranking = spark.createDataFrame([("D1", 2, "R1", 0.5, 1), ("D1", 1, "R2", 1234.5, 1), ("D2", 1, "R3", 1.0, 0)], "declaration_id string, rank int, regulation_id string, score double, input_ord long")
    files.write_predictions(ranking, str(tmp_path / "out"))
    part = next(p for p in os.listdir(tmp_path / "out") if p.startswith("part"))
    with open(tmp_path / "out" / part, encoding="utf-8") as f:
        assert [tuple(r.values()) for r in csv.DictReader(f)] == [("D2", "1", "R3", "1.000000"), ("D1", "1", "R2", "1234.500000"), ("D1", "2", "R1", "0.500000")]
    assert files.predictions(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(files.MissingInput):
        files.require(spark, str(tmp_path / "none"))


def test_predictions_of_many_tasks_are_those_of_one(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"D{d}", k, f"R{rng.randrange(50)}", rng.random(), 3 * d) for d in range(40) for k in range(1, 11)]
    rng.shuffle(rows)
    ranking = spark.createDataFrame(rows, "declaration_id string, rank int, regulation_id string, score double, input_ord long").repartition(5)
    texts = {}
    for parts in (1, 7):
        files.write_predictions(ranking, str(tmp_path / str(parts)), parts)
        names = sorted(p for p in os.listdir(tmp_path / str(parts)) if p.startswith("part"))
        bodies = [open(tmp_path / str(parts) / p, encoding="utf-8").read().split("\n", 1) for p in names]
        assert {head for head, _ in bodies} == {"declaration_id,rank,regulation_id,score"}
        texts[parts] = len(names), "".join(body for _, body in bodies)
    assert texts[1][0] == 1 and texts[7][0] > 4 and texts[1][1] == texts[7][1] and texts[1][1].count("\n") == 400
