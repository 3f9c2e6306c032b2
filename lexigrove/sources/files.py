"""Readers and writers of the ranking's inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store
from ..functions.text import declaration_text, strip

REGULATIONS = "regulation_id string, code string, description string, explanation string"
DECLARATIONS = "declaration_id string, G31_1 string, desc_extention string, G011 string, G34 string"
PREDICTIONS = "declaration_id string, rank int, regulation_id string, score double"
LABELS = "declaration_id string, regulation_id string, code string, runner_up string, confidence string, evidence string"


#: Rows of a file of predictions, about.
FILE_ROWS = 5_000_000


class MissingInput(ValueError):
    """An input does not exist."""


def require(spark: SparkSession, *paths: str) -> None:
    """Raise ``MissingInput`` if one of the paths does not exist in its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            raise MissingInput(path)


def regulations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing description is an error when it is used."""
    return spark.read.schema(REGULATIONS).json(path)


def declarations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the text of each declaration; ``input_ord`` is the place in the input.

    It orders by file, then by the split that a task read, then by the row in it, so that it holds over several files
    and splits, in whatever order these are dealt to tasks.
    """
    raw = spark.read.schema(DECLARATIONS).json(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    raw = raw.select("*", place.alias("input_ord"))
    clean = raw.select("declaration_id", strip(F.col("G31_1")).alias("g31"), strip(F.col("desc_extention")).alias("ext"), strip(F.col("G011")).alias("direction"), strip(F.col("G34")).alias("country"), "input_ord")
    return clean.withColumn("text", declaration_text(F.col("g31"), F.col("ext")))


def dump(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of texts whose line order matters, with any line end; nothing comes after a last line end.

    Files are read by byte ranges, as Spark splits them; a line belongs to the range that it begins in. Lines are
    counted by range, and the sums over the ranges before give their numbers, from 0.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    found = store.materialise(read, "dump-lines")  # written, so that both uses see the same numbers
    ranges = found.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    shifts = ranges.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return found.join(shifts, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(PREDICTIONS).csv(path)


def write_predictions(ranking: DataFrame, path: str, parts: int | None = None) -> None:
    """CSV files in the declarations' input order and then by rank, scores with six decimals, under a header.

    ``ranking``: (declaration_id, rank, regulation_id, score, input_ord). The rows are cut into ranges of (input_ord, rank), a task and a file
    each, about ``FILE_ROWS`` rows or ``parts`` of them: files in the order of their names, without their headers, are the one file that a single task
    would write. Spark puts all of them in place together at the end of the job.
    """
    shown = ranking.select("input_ord", "declaration_id", "rank", "regulation_id", F.format_string("%.6f", "score").alias("score"))
    parts = parts or max(1, -(-shown.count() // FILE_ROWS))
    ordered = (shown.repartition(1) if parts == 1 else shown.repartitionByRange(parts, "input_ord", "rank")).sortWithinPartitions("input_ord", "rank")
    ordered.drop("input_ord").write.mode("overwrite").option("header", True).csv(path)


def lemmas(spark: SparkSession, path: str) -> DataFrame:
    """(token, lemma) from a CSV with a header; of several lemmas of a token the smallest counts."""
    rows = spark.read.option("header", True).schema("token string, lemma string").csv(path)
    return rows.where("token is not null and lemma is not null").groupBy("token").agg(F.min("lemma").alias("lemma"))
