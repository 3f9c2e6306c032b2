"""The jobs: settings, reruns, growing input, replayed batches, odd rows, the command line."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, match_catalogue, route_arrivals

ENTRIES = [(1, "steel pipe of tariff code"), (2, "copper pipe"), (3, "wooden wheel"), (4, "steel wheel"), (5, None), (None, "steel")]
DOCS = [(10, "a steel pipe arrives", "en"), (11, "copper and steel", "en"), (12, "ein wheel", "de"), (13, "nothing known", "de"), (14, None, "fr"), (15, "wheel of wood", None), (None, "steel", "en"), (16, "steel steel wheel", "")]
LATER = [(20, "another copper pipe", "es"), (21, "wheel", "en")]


def save(spark, rows, path, ids="long", kind="docs"):
    schema = f"doc_id {ids}, text string, lang string" if kind == "docs" else f"item_id {ids}, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def rows_of(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def routes(spark, out, folder):
    return rows_of(route_arrivals.routes(spark, out, f"{folder}/in", f"{folder}/entries"), "doc_id", "rank", "entry_id", "lang")


@pytest.fixture
def folder(spark, tmp_path):
    save(spark, ENTRIES, f"{tmp_path}/entries", kind="entries")
    save(spark, DOCS, f"{tmp_path}/in")
    return str(tmp_path)


def run(spark, folder, out="out", config=None):
    return route_arrivals.run(spark, f"{folder}/in", f"{folder}/entries", f"{folder}/{out}", f"{folder}/{out}-checkpoint", config)


def test_arrivals_are_taken_once(spark, folder):
    assert run(spark, folder) == {"batches": 1, "documents": 7, "routes": 14}
    first = routes(spark, f"{folder}/out", folder)
    assert {(d, e) for d, k, e, _ in first if k == 1} == {(10, 1), (11, 2), (12, 4), (15, 4), (16, 4)} and {d for d, *_ in first} == {10, 11, 12, 15, 16}
    assert run(spark, folder) == {"batches": 0, "documents": 0, "routes": 0} and routes(spark, f"{folder}/out", folder) == first
    save(spark, LATER, f"{folder}/in")
    grown = run(spark, folder)
    assert grown["documents"] == 2 and grown["batches"] == 1
    both = routes(spark, f"{folder}/out", folder)
    assert set(first) < set(both) and {r[0] for r in set(both) - set(first)} == {20, 21}
    # What two runs wrote is what one run over everything writes.
    run(spark, folder, "whole")
    assert routes(spark, f"{folder}/whole", folder) == both
    assert {x for x in os.listdir(f"{folder}/out/routes") if "=" in x} == {"batch=0", "batch=1"} and "lang=en" in os.listdir(f"{folder}/out/routes/batch=0")


def test_a_batch_that_failed_is_replayed_without_loss_or_repeat(spark, folder, monkeypatch):
    written = common.write_counted

    def fails(*args, **options):
        written(*args, **options)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(route_arrivals, "write_counted", fails)
    with pytest.raises(Exception, match="lost after the write"):
        run(spark, folder)
    monkeypatch.setattr(route_arrivals, "write_counted", written)
    save(spark, LATER, f"{folder}/in")
    run(spark, folder)
    again = routes(spark, f"{folder}/out", folder)
    run(spark, folder, "whole")
    assert again == routes(spark, f"{folder}/whole", folder)


def test_backlogs_come_in_batches_of_files(spark, folder, tmp_path):
    save(spark, LATER, f"{folder}/in")
    (tmp_path / "c.json").write_text(json.dumps({"files_per_batch": 1, "top": 1}))
    counts = run(spark, folder, config=f"{folder}/c.json")
    assert counts["batches"] == 2 and counts["documents"] == 9 and {k for _, k, *_ in routes(spark, f"{folder}/out", folder)} == {1}


def test_no_arrivals_and_a_single_file(spark, tmp_path):
    save(spark, ENTRIES, f"{tmp_path}/entries", kind="entries")
    assert run(spark, str(tmp_path))["documents"] == 0
    save(spark, DOCS[:2], f"{tmp_path}/some")
    part = next(p for p in os.listdir(tmp_path / "some") if p.endswith(".parquet"))
    os.rename(tmp_path / "some" / part, tmp_path / "in")  # a file where a folder can be
    assert run(spark, str(tmp_path))["documents"] == 2 and run(spark, str(tmp_path))["documents"] == 0
    assert route_arrivals.stream_path("s3://b/in/", ["s3://b/in/part-0.parquet"]) == "s3://b/in" and route_arrivals.stream_path("s3://b/d.parquet", ["s3://b/d.parquet"]) == "s3://b/d.parque[t]"


def test_matching_writes_the_same_twice(spark, folder, tmp_path):
    save(spark, [(100 + k, f"pipe number {k}", "en") for k in range(12)], f"{folder}/in")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    found = [match_catalogue.run(spark, f"{folder}/entries", f"{folder}/in", f"{folder}/out") for _ in range(2)]
    assert found[0] == found[1] == {"queries": 5, "documents": 19, "predictions": 50, "violations": 0}
    got = rows_of(match_catalogue.predictions(spark, f"{folder}/out"), "query_id", "rank", "doc_id", "score")
    assert sorted(r[1] for r in got if r[0] == 1) == list(range(1, 11)) and {r[2] for r in got if r[1] == 1 and r[0] == 4} == {16}
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")) == before
    # A smaller catalogue replaces what was there; too few rows a query are refused.
    save(spark, DOCS[:3], f"{tmp_path}/few")
    counts = match_catalogue.run(spark, f"{folder}/entries", f"{folder}/few", f"{folder}/out")
    assert counts["predictions"] == 15 and counts["violations"] >= 5
    assert {x for x in os.listdir(f"{folder}/out/predictions") if "=" in x} == {"lang=en", "lang=de"}
    assert "row_count" in {r.rule for r in spark.read.parquet(f"{folder}/out/violations").collect()}


def test_repeated_ids_and_other_names(spark, tmp_path):
    spark.createDataFrame([("D1", "steel"), ("D1", "pipe"), ("D2", "wheel")], "q string, t string").write.parquet(f"{tmp_path}/q")
    spark.createDataFrame([("R1", "steel wheel", 1), ("R1", "pipe", 2), ("R2", "wheel", 1)], "r string, body string, year int").write.parquet(f"{tmp_path}/r")
    (tmp_path / "c.json").write_text(json.dumps({"query_id": "q", "query_text": "t", "doc_id": "r", "doc_text": "body", "partition": "year", "top": 2}))
    match_catalogue.run(spark, f"{tmp_path}/q", f"{tmp_path}/r", f"{tmp_path}/out", f"{tmp_path}/c.json")
    assert rows_of(match_catalogue.predictions(spark, f"{tmp_path}/out"), "query_id", "rank", "doc_id", "year") == [("D1", 1, "R1", 1), ("D1", 2, "R2", 1), ("D2", 1, "R2", 1), ("D2", 2, "R1", 1)]


def test_settings(spark, tmp_path):
    assert common.read_config(spark, None, {"a": 1}) == {"a": 1}
    (tmp_path / "c.json").write_text('{"a":\n 2}')
    assert common.read_config(spark, f"{tmp_path}/c.json", {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    with pytest.raises(ValueError, match="unknown settings: a"):
        common.read_config(spark, f"{tmp_path}/c.json", {})
    for module in (match_catalogue, route_arrivals):
        shipped = json.loads(open(module.__file__.replace(".py", ".json"), encoding="utf-8").read())
        assert shipped == module.SETTINGS


def test_command_line(spark, folder):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    command = [sys.executable, "-m", "jobs.route_arrivals", "--arrivals", f"{folder}/in", "--catalogue", f"{folder}/entries", "--out", f"{folder}/out", "--checkpoint", f"{folder}/cp", "--config", f"{root}/jobs/route_arrivals.json"]
    done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_MASTER": "local[2]"})
    assert done.returncode == 0 and "read 7 documents" in done.stderr and "wrote 14 routes" in done.stderr
    assert spark.read.parquet(f"{folder}/out/routes").where(F.col("rank") == 1).count() == 5
