"""Tables in between: registered queries leave only what they return."""

import os

from pyspark.sql import functions as F

from lexigrove import store


def test_a_tidy_query_leaves_its_result_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")

    @store.tidy
    def writes(spark, sf_dir):
        first = store.materialise(spark.range(5), "first")
        return store.materialise(first.select((F.col("id") * 2).alias("id")), "second").where("id > 2")

    @store.tidy
    def lazy(spark, sf_dir):
        return spark.range(3)

    assert sorted(r.id for r in writes(spark, "").collect()) == [4, 6, 8]
    assert [p.split("-")[0] for p in os.listdir(tmp_path)] == ["writes"]
    assert lazy(spark, "").count() == 3 and len(os.listdir(tmp_path)) == 1

    @store.tidy
    def outer(spark, sf_dir):
        return writes(spark, sf_dir).limit(1)

    assert outer(spark, "").count() == 1 and sorted(p.split("-")[0] for p in os.listdir(tmp_path)) == ["outer", "writes"]


def test_a_failed_query_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")

    @store.tidy
    def fails(spark, sf_dir):
        store.materialise(spark.range(5), "first")
        raise ValueError("no")

    try:
        fails(spark, "")
    except ValueError:
        pass
    assert os.listdir(tmp_path) == []


def test_more_rows_are_more_partitions(spark, monkeypatch):
    """What a task sorts does not grow with the input."""
    monkeypatch.setattr(store, "PART_ROWS", 100)
    rows = spark.range(1000)
    assert store.spread(rows, 1000, "id").rdd.getNumPartitions() == 10
    assert store.spread(rows, 300, "id") is rows


def test_lines_are_numbered_over_several_files(spark, monkeypatch):
    from lexigrove.queries_catalogue import files, files_round_trip

    monkeypatch.setattr(files, "FILE_ROWS", 100)
    rows = files_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 200 and sorted(r.line for r in rows) == list(range(len(rows)))
