import random

import __spark_entry__
import corpus_pipeline
from lexigrove.llm import queries as llm


def test_queries_are_registered():
    names = set(llm.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 13)} and len(names) == 12
    assert "pipeline" in __spark_entry__.queries() and set(llm.oracle_sql()) <= names


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(260):
        own = [word() for _ in range(40)]
        if i % 5 == 0:
            own[4] = own[30] = "vilebad"
        rows.append((i, " ".join(own), "en", f"s{i % 4}", 1))
        labels.append((i, 0, int(i % 5 == 0)))
    item = " ".join(word() for _ in range(20))
    rows[1] = (1, f"{word()} {item} {word()}", "en", "s1", 1)
    rows[3] = (3, rows[2][1], "en", None, 1)
    rows += [(300, None, "en", "s1", 1), (301, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {r[0] for r in rows}
    assert kept[0] == everything - set(range(0, 260, 5)) and kept[1] == kept[0] - {3} and kept[2] == kept[1] - {1}
    found = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert {r.doc_id for r in found} <= kept[2] and all(b.start == a.start + a.n_tokens for a, b in zip(found, found[1:], strict=False))
