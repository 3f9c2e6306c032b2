"""How a declaration's quantities stand to a regulation's intervals: 1, 0 or -1.

Texts are parsed once each; pairs are then an equi-join on the unit's family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store
from ..functions.quantities import COMPARED, QUANTITY, comparisons, contains, family, intervals, matches, quantities
from ..functions.text import lemmatise, normalise


def _matched(texts: DataFrame, key: str, text: str, pattern: str, groups: int) -> DataFrame:
    """(key, g1.., marked): step by step, so that no regular expression is evaluated inside a lambda."""
    norm = texts.select(key, normalise(F.col(text)).alias("norm"))
    return norm.select(key, *[c.alias(n) for n, c in matches(F.col("norm"), pattern, groups).items()])


def _dealt(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The texts of a catalogue: few bytes, which one or two tasks would read, and much work a text. The number of partitions is
    given, so that they are not put together again by their bytes."""
    return texts.select(key, text).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _parts(groups: int) -> dict[str, Column]:
    return {n: F.col(n) for n in [*(f"g{g}" for g in range(1, groups + 1)), "marked"]}


def comparison_rows(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, word, value, unit, is_lower, strict, subject)."""
    found = _matched(_dealt(texts, key, text), key, text, COMPARED, 3).select(key, F.posexplode(comparisons(_parts(3))).alias("pos", "m"))
    return found.select(key, "pos", "m.*")


def interval_rows(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, unit, lo, lo_strict, hi, hi_strict, subject, family)."""
    found = _matched(_dealt(texts, key, text), key, text, COMPARED, 3).select(key, comparisons(_parts(3)).alias("found"))
    rows = found.select(F.col(key).alias("doc_id"), F.posexplode(intervals(F.col("found"))).alias("pos", "i"))
    return rows.select("doc_id", "pos", "i.*").withColumn("family", family(F.col("unit")))


def quantity_rows(texts: DataFrame, key: str = "query_id", text: str = "text", subjects: bool = True) -> DataFrame:
    """(query_id, pos, unit, value, subject if wanted, family)."""
    found = _matched(texts, key, text, QUANTITY, 2)
    rows = found.select(F.col(key).alias("query_id"), F.posexplode(quantities(_parts(2), subjects)).alias("pos", "q"))
    return rows.select("query_id", "pos", "q.*").withColumn("family", family(F.col("unit")))


def lemmatised(rows: DataFrame, key: str, lemmas: DataFrame | None) -> DataFrame:
    """Interval or quantity rows with the lemmas of their subject's words, by ``lemmas`` (token, lemma); see ``lemmatise``."""
    if lemmas is None:
        return rows
    words = lemmatise(rows.select(key, "pos", F.explode("subject").alias("token")), lemmas)
    found = words.groupBy(key, "pos").agg(F.collect_set("token").alias("found"))
    return rows.join(found, [key, "pos"], "left").withColumn("subject", F.coalesce("found", F.array().cast("array<string>"))).drop("found")


def signal(pairs: DataFrame, found_intervals: DataFrame, found_quantities: DataFrame) -> DataFrame:
    """``pairs`` (query_id, doc_id, …) with ``signal``.

    For each interval the quantities of its own unit count, or if there are none and it is a
    percentage those of any percentage. Of several the one that shares most subject words is
    taken, if it shares any and no other shares as many; otherwise the interval says nothing. One
    violated interval makes the pair -1, else one satisfied makes it 1.
    """
    i = found_intervals.select("doc_id", F.col("pos").alias("i_pos"), F.col("unit").alias("i_unit"), "family", F.struct("lo", "lo_strict", "hi", "hi_strict").alias("bounds"), F.col("subject").alias("i_subject"))
    q = found_quantities.select("query_id", F.col("pos").alias("q_pos"), F.col("unit").alias("q_unit"), "family", "value", F.col("subject").alias("q_subject"))
    rows = pairs.count()
    # By all keys of what follows: Spark deals anew, over the session's number of partitions, what lies by a part of a join's keys.
    of = lambda df, *keys: store.spread(df, rows, *keys)
    met = of(pairs.select("query_id", "doc_id"), "query_id", "doc_id").distinct()
    met = of(met, "doc_id").join(of(i, "doc_id"), "doc_id")
    met = of(met, "query_id", "family").join(of(q, "query_id", "family"), ["query_id", "family"])
    met = of(met.where((F.col("i_unit") == F.col("q_unit")) | (F.col("family") == "pct")), "query_id", "doc_id")
    each = Window.partitionBy("query_id", "doc_id", "i_pos")
    exact = F.col("i_unit") == F.col("q_unit")
    met = met.withColumn("any_exact", F.max(exact).over(each)).where(exact | ~F.col("any_exact"))
    overlap = F.size(F.array_intersect("i_subject", "q_subject"))
    best = each.orderBy(F.col("overlap").desc(), "q_pos")
    met = met.withColumn("overlap", overlap).withColumn("n", F.count(F.lit(1)).over(each))
    met = met.withColumn("place", F.row_number().over(best)).withColumn("next", F.lead("overlap").over(best))
    chosen = met.where((F.col("place") == 1) & ((F.col("n") == 1) | ((F.col("overlap") > 0) & (F.col("next") < F.col("overlap")))))
    verdict = F.when(contains(F.col("bounds"), F.col("value")), 1.0).otherwise(-1.0)
    said = chosen.groupBy("query_id", "doc_id").agg(F.min(verdict).alias("signal"))
    return of(pairs, "query_id", "doc_id").join(said, ["query_id", "doc_id"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
