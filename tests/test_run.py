import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.__main__ import main
from lexigrove.functions import text as tx
from lexigrove.operators import constraints, evaluate, scorers
from lexigrove.plans import ranking
from lexigrove.plans.run import DECLARATIONS, DUMP as DUMP_NAME, REGULATIONS, choose, run, scorer_of
from lexigrove.sources import files
from tests.test_tree_views import DUMP


def inputs(tmp_path, n=12):
    regs = [{"regulation_id": f"R{k}", "code": f"27101942{k:02d}", "description": f"Газойли вид {'абвгдежзиклм'[k]}{k} с серой", "explanation": None} for k in range(n)]
    decs = [{"declaration_id": f"D{k}", "G31_1": f"газойли вид {'абвгдежзиклм'[k]}{k}", "desc_extention": "сера 0,01 мас.%"} for k in (5, 2)]
    for name, rows in (("r", regs), ("d", decs)):
        (tmp_path / name).write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    (tmp_path / "t").write_text(DUMP, encoding="utf-8")
    return [str(tmp_path / x) for x in "rdt"]


def test_run(spark, tmp_path):
    paths = inputs(tmp_path)
    assert run(spark, *paths, str(tmp_path / "out"), ranking.Config(n_candidates=12, constraint_weight=0.02)) == []
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert [r.declaration_id for r in rows] == ["D5"] * 10 + ["D2"] * 10 and rows[0].regulation_id == "R5" and rows[10].regulation_id == "R2"


def test_gate_refuses_short_rankings(spark, tmp_path):
    assert {r[0] for r in run(spark, *inputs(tmp_path, 4), str(tmp_path / "out"))} == {"row_count", "ranks"}


@pytest.fixture
def cli(spark, monkeypatch):
    """The command line over the tests' session."""
    builder = type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: spark})
    monkeypatch.setattr("lexigrove.__main__.SparkSession", type("S", (), {"builder": builder()}))
    return main


def folder(tmp_path):
    for path, name in zip(inputs(tmp_path), (REGULATIONS, DECLARATIONS, DUMP_NAME), strict=True):
        os.rename(path, tmp_path / name)
    return ["--data", str(tmp_path), "--out", str(tmp_path / "out")]


def test_missing_input(cli, tmp_path):
    assert cli(["--data", "/no", "--out", str(tmp_path), "--pipeline", "lexical"]) == 2


def test_missing_models_and_gpu(cli, tmp_path):
    given = folder(tmp_path)
    assert cli([*given, "--lock", str(tmp_path / "none")]) == 2  # auto without a GPU is cpu, which needs its model
    assert cli([*given, "--pipeline", "gpu"]) == 2
    (tmp_path / "lock").write_text("{}")
    assert cli([*given, "--pipeline", "cpu", "--lock", str(tmp_path / "lock")]) == 2


def test_command_line_reranks(spark, cli, tmp_path, monkeypatch):
    given = folder(tmp_path)
    scorers.write_lock({ranking.CPU.cross_encoder: "abc"}, str(tmp_path / "lock"))
    os.makedirs(tmp_path / "models" / ranking.CPU.cross_encoder.replace("/", "--") / "abc")
    seen = {}

    def stub(name, folder, batch, max_length, device):
        seen.update(name=name, folder=folder, batch=batch, max_length=max_length, int8=device.int8)
        # Longer documents, and of equal ones those of a later letter, are better.
        return scorers.ModelScorer(lambda where: lambda qs, ds: [len(d) + ord(d[-1]) / 1e4 for d in ds], folder, batch)

    monkeypatch.setattr("lexigrove.plans.run.scorer_for", stub)
    assert cli([*given, "--pipeline", "cpu", "--lock", str(tmp_path / "lock"), "--models", str(tmp_path / "models")]) == 0
    assert seen["name"] == "BAAI/bge-reranker-v2-m3" and (seen["batch"], seen["max_length"], seen["int8"]) == (24, 192, True)
    plain = run(spark, *[str(tmp_path / n) for n in (REGULATIONS, DECLARATIONS, DUMP_NAME)], str(tmp_path / "plain"), ranking.Config(n_candidates=12, constraint_weight=0.02))
    assert plain == []
    read = lambda path: [r.regulation_id for r in spark.read.option("header", True).csv(path).orderBy("declaration_id", F.col("rank").cast("int")).collect()]
    assert read(str(tmp_path / "out" / "predictions.csv")) != read(str(tmp_path / "plain"))


def test_gate_stops_a_bad_ranking(cli, tmp_path):
    for path, name in zip(inputs(tmp_path, 4), (REGULATIONS, DECLARATIONS, DUMP_NAME), strict=True):
        os.rename(path, tmp_path / name)
    assert cli(["--data", str(tmp_path), "--out", str(tmp_path / "out"), "--pipeline", "lexical"]) == 1


def test_scorer_of_a_configuration(tmp_path):
    assert scorer_of(ranking.LEXICAL, "/no", "/no") is None
    with pytest.raises(FileNotFoundError):
        scorer_of(ranking.CPU, "/no", "/no")
    assert scorers.is_causal(ranking.GPU.cross_encoder) and not scorers.is_causal(ranking.CPU.cross_encoder)


class Words:
    """A tokenizer whose ids are the places of words in a growing list."""

    def __init__(self):
        self.known = []

    def encode(self, text, add_special_tokens):
        return [self.known.index(w) if w in self.known else self.known.append(w) or len(self.known) - 1 for w in text.split()]


def test_prompts_are_cut_inside_the_template():
    words = Words()
    begin, end = words.encode(tx.PROMPT_BEGIN, False), words.encode(tx.PROMPT_END, False)
    short = scorers.question_ids(words, tx.TASK, "q", "d", 512)
    assert short == begin + words.encode(tx.PROMPT_BODY % (tx.TASK, "q", "d"), False) + end
    long = scorers.question_ids(words, tx.TASK, "q", "d " * 900, 512)
    assert len(long) == 512 and long[: len(begin)] == begin and long[-len(end) :] == end


def test_mean_pool():
    hidden = np.array([[[3.0, 4.0], [100.0, 100.0]], [[0.0, 0.0], [0.0, 0.0]]])
    assert scorers.mean_pool(hidden, np.array([[1, 0], [0, 0]])).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_embed_refuses_what_is_not_finite(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, text string")
    closed = scorers.embed(texts, lambda where: lambda ts: [[float(len(t)), 1.0] for t in ts], "")
    assert {r.id: r.vector for r in closed.collect()} == {1: [1.0, 1.0], 2: [2.0, 1.0]}
    with pytest.raises(Exception, match="not finite"):
        scorers.embed(texts, lambda where: lambda ts: [[float("inf")] for _ in ts], "").collect()


def test_lemmas_bring_forms_together(spark):
    docs = spark.createDataFrame([(1, "колесо стальное"), (2, "труба медная"), (3, "окно")], "doc_id long, coarse_text string").withColumn("fine_text", F.col("coarse_text")).withColumn("disc_text", F.lit("масса не более 5 кг"))
    queries = spark.createDataFrame([(1, "трубы медные, массы 7 кг")], "query_id long, text string")
    lemmas = spark.createDataFrame([("трубы", "труба"), ("медные", "медный"), ("медная", "медный"), ("массы", "масса")], "token string, lemma string")
    config = ranking.Config(weights={"word": 1.0}, n_candidates=3, top_k=3, constraint_weight=0.5)
    assert [r.doc_id for r in ranking.rank(queries, docs, config, lemmas=lemmas).orderBy("rank").collect()][0] == 2
    assert [r.doc_id for r in ranking.rank(queries, docs, config).orderBy("rank").collect()] == [1, 2, 3]
    subject = lambda table: sorted(constraints.lemmatised(constraints.quantity_rows(queries), "query_id", table).first().subject)
    assert subject(lemmas) == ["масса", "медный", "труба"] and subject(None) == ["массы", "медные", "трубы"]


def test_declarations_keep_their_order_over_files_and_splits(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"d{part}.jsonl").write_text("\n".join(json.dumps({"declaration_id": f"D{part}-{k:04d}", "G31_1": "x" * 200}) for k in range(400)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.declarations(spark, str(tmp_path)).orderBy("input_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.declaration_id for r in rows] == [f"D{part}-{k:04d}" for part in range(3) for k in range(400)]


def test_choice():
    assert choose("auto") is ranking.CPU and choose("auto", gpu=True) is ranking.GPU and choose("cpu", n_candidates=16).n_candidates == 16
    with pytest.raises(ValueError):
        choose("gpu")


def test_label_checks(spark):
    regs = spark.createDataFrame([("R1", "1000"), ("R2", "1000"), ("R3", "1000"), ("R4", "2000")], "regulation_id string, code string")
    labels = spark.createDataFrame([("R1", "high"), ("R4", "low")], "regulation_id string, confidence string")
    assert tuple(evaluate.label_checks(labels, regs).first()) == (2, 2, 1, 1)
    assert {r.confidence: r.n for r in evaluate.confidences(labels).collect()} == {"high": 1, "low": 1}
