"""Route arriving documents to the entries of a catalogue: takes only files that have come since the last run.

    python -m jobs.route_arrivals --arrivals PATH --catalogue PATH --out PATH --checkpoint PATH [--config FILE]

Files of Parquet that appear under ARRIVALS are read as a stream, to the end of what is there, and the checkpoint keeps which were
taken. Every document gets its best entries of the catalogue by the cosine of word TF-IDF vectors, with the catalogue as corpus.
``OUT/routes`` (doc_id, entry_id, rank, score, partitioned by micro-batch and by a column of the documents) grows with each run. A batch that is replayed
after a failure replaces its own partitions, so that nothing is lost or there twice; a run without new files changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobs.common import log, main, read_config, write_counted
from lexigrove import store
from lexigrove.operators import products, retrieval

SETTINGS = {"doc_id": "doc_id", "doc_text": "text", "partition": "lang", "entry_id": "item_id", "entry_text": "text", "top": 3, "files_per_batch": 64}


def run(spark: SparkSession, arrivals: str, catalogue: str, out: str, checkpoint: str, config: str | None = None) -> dict:
    """Counts of what this run read and wrote.

    Documents without an id or without a word of the catalogue get no route. Rows that share an id within a batch count as one text.
    The catalogue is taken as it is at the run; routes of earlier runs stay.
    """
    c = read_config(spark, config, SETTINGS)
    counts = {"batches": 0, "documents": 0, "routes": 0}
    entries = spark.read.parquet(catalogue).select(F.col(c["entry_id"]).alias("entry_id"), F.col(c["entry_text"]).alias("text")).where("entry_id is not null")
    size = retrieval.corpus_size(entries.select("entry_id").distinct())

    def each(batch: DataFrame, number: int) -> None:
        seen = Observation()
        docs = batch.select(F.col(c["doc_id"]).alias("doc_id"), F.col(c["doc_text"]).alias("text"), F.col(c["partition"]).alias(c["partition"])).where("doc_id is not null")
        with store.scratch(spark):
            docs = store.materialise(docs.observe(seen, F.count(F.lit(1)).alias("rows")), "arrived")  # read once
            leg = retrieval.arrivals_text_leg(docs, "text", *retrieval.catalogue_terms(entries, "text", size))
            found = products.best_of_each(leg, c["top"]).select("doc_id", F.col("query_id").alias("entry_id"), "score")
            order = Window.partitionBy("doc_id").orderBy(F.round("score", products.DIGITS).desc(), "entry_id")  # no more than top rows from each group of entries
            best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= c["top"])
            known = docs.groupBy("doc_id").agg(F.min(c["partition"]).alias(c["partition"]))
            rows = best.join(known, "doc_id").withColumn("batch", F.lit(number))
            written = write_counted(rows, f"{out}/routes", ["batch", c["partition"]], dynamic=True)
        read = seen.get["rows"]
        counts["batches"], counts["documents"], counts["routes"] = counts["batches"] + 1, counts["documents"] + read, counts["routes"] + written
        log.info("batch %d: read %d documents of %s, wrote %d routes to %s", number, read, arrivals, written, out)

    try:
        there = spark.read.parquet(arrivals)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log.info("nothing has arrived in %s", arrivals)
        return counts
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(stream_path(arrivals, there.inputFiles()))
    started = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    log.info("read %d documents in %d batches, wrote %d routes", counts["documents"], counts["batches"], counts["routes"])
    return counts


def stream_path(path: str, files: list[str]) -> str:
    """The path as a file stream takes it: a folder as it is, a single file as a pattern that only it matches."""
    path = path.rstrip("/")
    single = len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]
    return f"{path[:-1]}[{path[-1]}]" if single else path


def routes(spark: SparkSession, out: str, arrivals: str, catalogue: str, config: str | None = None) -> DataFrame:
    """All routes of all runs. The types are those of the inputs, so that an output without rows can be read too."""
    c = read_config(spark, config, SETTINGS)
    docs, entries = dict(spark.read.parquet(arrivals).dtypes), dict(spark.read.parquet(catalogue).dtypes)
    schema = f"doc_id {docs[c['doc_id']]}, entry_id {entries[c['entry_id']]}, score double, rank int, batch int, `{c['partition']}` {docs[c['partition']]}"
    return spark.read.schema(schema).parquet(f"{out}/routes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as arrivals and the benchmark as catalogue, run twice with one new folder and checkpoint."""
    folder = f"{store.shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    paths = f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet"
    for _ in range(2):
        run(spark, *paths, folder, f"{folder}/checkpoint")
    found = routes(spark, folder, *paths)
    return found.select("doc_id", "entry_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "lang")


if __name__ == "__main__":
    main("route_arrivals", __doc__, ["arrivals", "catalogue", "out", "checkpoint"], run)
