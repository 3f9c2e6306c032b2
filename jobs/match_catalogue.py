"""Match a batch of texts to a catalogue and publish the checked ranking, partitioned by a column of the catalogue.

    python -m jobs.match_catalogue --queries PATH --catalogue PATH --out PATH [--config FILE]

Reads two Parquet tables and runs the whole lexical ranking: fused ranks of the legs, candidates, normalised and strictly decreasing scores. Writes
``OUT/predictions`` (query_id, rank, doc_id, score, and the catalogue's column as partition) and ``OUT/violations``: what the output gate
refuses. A run replaces both; the same input gives the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, read_config, write_counted
from lexigrove import store
from lexigrove.operators import evaluate
from lexigrove.plans import ranking

SETTINGS = {"query_id": "item_id", "query_text": "text", "doc_id": "doc_id", "doc_text": "text", "partition": "lang", "char_weight": 3.0, "word_weight": 1.0, "candidates": 16, "top": 10}


def run(spark: SparkSession, queries: str, catalogue: str, out: str, config: str | None = None) -> dict:
    """Counts of what was read and written. Rows without an id take no part; of rows that share one the texts count as one text."""
    c = read_config(spark, config, SETTINGS)
    asked = spark.read.parquet(queries).select(F.col(c["query_id"]).alias("query_id"), F.col(c["query_text"]).alias("text")).where("query_id is not null")
    docs = spark.read.parquet(catalogue).select(F.col(c["doc_id"]).alias("doc_id"), F.col(c["doc_text"]).alias("coarse_text"), F.col(c["partition"]).alias("partition")).where("doc_id is not null")
    plan = ranking.Config(weights={"char": c["char_weight"], "word": c["word_weight"]}, n_candidates=c["candidates"], top_k=c["top"])
    with store.scratch(spark):
        known = docs.groupBy("doc_id").agg(F.min("partition").alias(c["partition"]))
        texts = store.materialise(docs.groupBy("doc_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("coarse_text"))).alias("coarse_text")), "texts")  # every leg reads them twice
        ids = asked.select("query_id").distinct()
        counts = {"queries": ids.count(), "documents": known.count()}
        log.info("read %d queries of %s and %d documents of %s", counts["queries"], queries, counts["documents"], catalogue)
        ranked = ranking.rank(asked.groupBy("query_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text")), texts, plan, apart=True)
        counts["predictions"] = write_counted(ranked.join(known, "doc_id"), f"{out}/predictions", [c["partition"]])
        written = predictions(spark, out)
        named = written.select(F.col("query_id").alias("declaration_id"), "rank", F.col("doc_id").alias("regulation_id"), "score")
        refused = evaluate.violations(named, ids.withColumnRenamed("query_id", "declaration_id"), known.select(F.col("doc_id").alias("regulation_id")))
        counts["violations"] = write_counted(refused, f"{out}/violations", ["rule"])
    log.info("wrote %d predictions and %d violations to %s", counts["predictions"], counts["violations"], out)
    return counts


def predictions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/predictions")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts against all documents, run twice into one new folder."""
    out = f"{store.shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", out)
    return predictions(spark, out).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "lang")


if __name__ == "__main__":
    main("match_catalogue", __doc__, ["queries", "catalogue", "out"], run)
