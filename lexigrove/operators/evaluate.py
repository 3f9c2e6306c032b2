"""Ranking quality and the gate that a ranking must pass before it is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store

CUTS = (1, 3, 5, 10)
Z = 1.96
COLUMNS = ("declaration_id", "rank", "regulation_id", "score")


def metrics(ranking: DataFrame, gold: DataFrame, query: str = "declaration_id", doc: str = "regulation_id") -> DataFrame:
    """One row: n, hit1, hit3, hit5, hit10, mrr10 over all of ``gold``; a gold pair not ranked is a miss."""
    placed = gold.select(query, doc).join(ranking.select(query, doc, "rank"), [query, doc], "left")
    hits = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit{k}") for k in CUTS]
    return placed.agg(F.count(F.lit(1)).alias("n"), *hits, F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr10"))


def wilson(share: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share, within 0 and 1; (0, 0) for n = 0."""
    middle = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    zero = F.coalesce(n == 0, F.lit(True))
    return F.when(zero, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(zero, 0.0).otherwise(F.least(F.lit(1.0), middle + half))


def report(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """Metrics with the interval of hit1."""
    found = metrics(ranking, gold)
    low, high = wilson(F.col("hit1"), F.col("n"))
    return found.withColumns({"hit1_low": low, "hit1_high": high})


def label_checks(labels: DataFrame, regulations: DataFrame, block: int = 3, digits: int = 4) -> DataFrame:
    """One row about a label set: n, different regulations, blocks of ``block`` regulations of a heading (``digits`` of the code), and how many have just one label."""
    headings = regulations.select("regulation_id", F.substring("code", 1, digits).alias("heading"))
    counted = headings.join(labels.select("regulation_id", F.lit(1).alias("labelled")), "regulation_id", "left")
    blocks = counted.groupBy("heading").agg(F.count_distinct("regulation_id").alias("size"), F.count("labelled").alias("n")).where(F.col("size") == block)
    found = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("n") == 1).alias("blocks_with_one"))
    return labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("regulation_id").alias("different")).crossJoin(found)


def confidences(labels: DataFrame) -> DataFrame:
    return labels.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def error_levels(misses: DataFrame) -> DataFrame:
    """(level, n) of wrong first places by the longest code prefix that ``chosen`` and ``gold`` share: 6, 4, 2 or 0."""
    level = F.lit(0)
    for k in (2, 4, 6):
        level = F.when(F.substring("chosen", 1, k) == F.substring("gold", 1, k), k).otherwise(level)
    return misses.withColumn("level", level).rollup("level").agg(F.count(F.lit(1)).alias("n"))


def violations(ranking: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(rule, declaration_id, detail): everything about a ranking that the gate refuses; none if it is valid.

    Rules: no rows; a column missing; an unknown or absent declaration; not k rows; ranks other than
    1..k; a regulation twice; an unknown regulation; a score that is not finite; a score that rises.
    """
    spark = ranking.sparkSession
    schema = "rule string, declaration_id string, detail string"
    if missing := [c for c in COLUMNS if c not in ranking.columns]:
        return spark.createDataFrame([("columns", None, c) for c in missing], schema)
    r = ranking.select(F.col("declaration_id").cast("string"), F.col("rank").cast("long").alias("rank"), F.col("regulation_id").cast("string"), F.col("score").cast("double").alias("score"))
    r = store.spread(r, ranking.count(), "declaration_id")
    known, wanted = docs.select(F.col("regulation_id").cast("string")).distinct(), queries.select(F.col("declaration_id").cast("string")).distinct()
    said = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), "declaration_id", detail.cast("string").alias("detail"))
    groups = r.groupBy("declaration_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("rank")).alias("ranks"), F.count_distinct("regulation_id").alias("different"))
    fall = Window.partitionBy("declaration_id").orderBy("rank")
    odd = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    parts = [
        r.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty").alias("rule"), F.lit(None).cast("string").alias("declaration_id"), F.lit("0").alias("detail")),
        said(r.select("declaration_id").distinct().join(wanted, "declaration_id", "left_anti"), "unknown_declaration", F.col("declaration_id")),
        said(wanted.join(r, "declaration_id", "left_anti"), "absent_declaration", F.col("declaration_id")),
        said(groups.where(F.col("n") != k), "row_count", F.col("n")),
        said(groups.where(F.col("ranks") != F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))), "ranks", F.array_join(F.col("ranks").cast("array<string>"), ",")),
        said(groups.where("different <> n"), "duplicate_regulation", F.col("different")),
        said(r.join(known, "regulation_id", "left_anti"), "unknown_regulation", F.col("regulation_id")),
        said(r.where(odd), "not_finite", F.col("rank")),
        said(r.withColumn("before", F.lag("score").over(fall)).where("before < score"), "rising_score", F.col("rank")),
    ]
    return reduce(DataFrame.unionByName, parts)
