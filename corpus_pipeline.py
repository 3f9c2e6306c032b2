"""A corpus from raw documents to token files: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it back from Parquet. All
stages need the columns doc_id, text and source of ``docs`` and pass on whatever else it has, under any
names; texts are taken whole, however long. A row without a doc_id is a document named by a hash of its text.
An empty table goes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove import store
from lexigrove.llm import decontaminate, mixing, neardup, tokenfiles, toxicity
from lexigrove.llm.queries import table


def _id(docs: DataFrame) -> Column:
    """A row's doc_id, or a hash of its text in place of a null."""
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(_id(docs).alias("doc_id"), docs["text"])


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not among the ``rejected``."""
    gone = rejected.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, _id(docs) == gone["gone_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, all their rows.

    A null or empty text has no evidence against it and stays, unless most labelled documents are toxic. Rows
    of one doc_id are scored apart and go together, if one is toxic; so do null ids with equal texts.
    Without labels, or with null ones only, nothing goes.
    """
    scored = toxicity.score(_named(docs), table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Texts without words (null, empty, blank) are no duplicates of anything and stay. Rows of one doc_id are one
    document: if it stays, each of its different texts does, and equal rows once. Ties cannot occur, as ids differ.
    """
    found = neardup.near_duplicates(_named(docs))
    left = _without(docs, found.where("not kept"))
    several = store.materialise(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("several_id")), "stage-several")
    if several.isEmpty():
        return left
    again = left.join(several, _id(left) == several["several_id"], "left_semi")
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    once = again.toDF(*names).groupBy(key, F.xxhash64(text)).agg(F.first(F.struct(*names)).alias("row")).select("row.*").toDF(*docs.columns)
    return left.join(several, _id(left) == several["several_id"], "left_anti").union(once)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and blank texts hold none, and blank items are in none. If one row of a doc_id holds an item, all go. Without
    benchmark items nothing goes.
    """
    return _without(docs, decontaminate.leaks(_named(docs), table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, as rows.

    A null source is a source. Texts without words have no size and are not taken. Of rows that agree in doc_id, source and
    text one stands for all, as often as they are taken together. Draws are fixed by the rows, so that a rerun agrees.
    """
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each document when read back.

    A null or empty text holds the end id alone. Rows of one doc_id are documents of their own, ordered by a hash of
    their text; null ids come first and stay null.
    """
    return tokenfiles.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", token_files),
]

#: SQL can express neither a fitted classifier nor dependent rounding nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table ``documents``, each written and read back; what is written goes at the end."""
    docs = table(spark, sf_dir, "documents")
    with store.scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = store.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        return store.kept(STAGES[-1][1](spark, docs, sf_dir), "stage-files")
