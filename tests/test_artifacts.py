"""Snapshots that travel with the application, and resources of stages."""

import os

import pytest

from lexigrove.operators import artifacts
from lexigrove.operators.scorers import ModelScorer, embed, gpu_visible


@pytest.fixture
def folder(tmp_path):
    own = tmp_path / "model"
    (own / "inner").mkdir(parents=True)
    (own / "weights.txt").write_text("2.5")
    (own / "inner" / "vocabulary.txt").write_text("a b")
    return own


def test_a_stand_in_model_loads_where_its_folder_is_not(spark, folder):
    sent = artifacts.ship(spark, str(folder))
    assert artifacts.ship(spark, str(folder)) == sent
    os.rename(folder, f"{folder}-gone")  # only the archive is left

    def load(where):
        assert where != str(folder) and os.path.exists(os.path.join(where, "inner", "vocabulary.txt"))
        with open(os.path.join(where, "weights.txt"), encoding="utf-8") as f:
            weight = float(f.read())
        return lambda qs, ds: [weight * len(q) for q in qs]

    pairs = spark.createDataFrame([(1, 2, "ab", "x"), (1, 3, "ab", "y")], "query_id long, doc_id long, query_text string, doc_text string")
    assert {r.score for r in ModelScorer(load, sent).score(pairs).collect()} == {5.0}
    texts = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert embed(texts, lambda where: lambda ts: [[float(os.path.getsize(os.path.join(where, 'weights.txt')))] for _ in ts], sent).first().vector == [3.0]


def test_a_snapshot_without_files_arrives(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    sent = artifacts.ship(spark, str(tmp_path / "empty"))
    texts = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert embed(texts, lambda where: lambda ts: [[float(os.path.isdir(where))] for _ in ts], sent).first().vector == [1.0]


def test_each_fault_is_an_error_of_its_own(spark, folder):
    with pytest.raises(FileNotFoundError, match="no folder"):
        artifacts.ship(spark, str(folder / "none"))
    sent = artifacts.ship(spark, str(folder))
    pairs = spark.createDataFrame([(1, 2, "ab", "x")], "query_id long, doc_id long, query_text string, doc_text string")
    score = lambda shipped: ModelScorer(lambda where: lambda qs, ds: [1.0] * len(qs), shipped).score(pairs).collect()
    with pytest.raises(Exception, match="has not reached this worker"):
        score(artifacts.Shipped("model-none", sent.digest))
    with pytest.raises(Exception, match="is not what was sent"):
        score(artifacts.Shipped(sent.name, "0" * 64))
    assert len(score(sent)) == 1


def test_digest_is_of_names_and_contents(folder):
    before = artifacts.folder_digest(str(folder))
    os.rename(folder / "weights.txt", folder / "weight.txt")
    renamed = artifacts.folder_digest(str(folder))
    os.rename(folder / "weight.txt", folder / "weights.txt")
    assert before == artifacts.folder_digest(str(folder)) != renamed
    (folder / "weights.txt").write_text("2.6")
    assert artifacts.folder_digest(str(folder)) not in (before, renamed)


def test_resources(spark):
    assert artifacts.executors_have_gpu(spark) == gpu_visible()
    profile = artifacts.gpu_profile(2)
    assert profile.taskResources["gpu"].amount == 1.0 and profile.taskResources["cpus"].amount == 1.0
    assert profile.executorResources["gpu"].amount == 1 and profile.executorResources["cores"].amount == 2
    frame = spark.range(1)
    assert artifacts.profile_for(frame, True) is None and artifacts.profile_for(frame, False) is None
