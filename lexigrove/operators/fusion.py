"""Reciprocal rank fusion, normalisation, adjustment and the final ranking."""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store
from . import products, retrieval

K = 60
#: Entries of each leg that the first round of ``best_fused`` looks at, a query, and by how much more later ones do.
DEPTH, DEEPER = 64, 8
#: The first round's entries where the legs are many texts: these seldom agree within 64, and a second round is one more look at all vectors.
FAR = 192

_log = logging.getLogger(__name__)


def rrf(legs: list[tuple[DataFrame, float]], k: int = K, keys: tuple[str, ...] = ("query_id", "doc_id"), deal: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """Sum of weight / (k + rank) over the legs, each a frame (query_id, doc_id, rank) with ranks from 1.

    A pair that is missing in a leg gets nothing from it. ``deal``: brings rows of the same keys together, where the session's partitions would grow too large.
    """
    rows = [leg.select(*keys, (F.lit(float(weight)) / (k + F.col("rank"))).alias("part")) for leg, weight in legs]
    return deal(reduce(DataFrame.unionByName, rows)).groupBy(*keys).agg(F.sum("part").alias("score"))


def best_fused(legs: dict[str, products.Leg], weights: dict[str, float], queries: DataFrame, docs: DataFrame, n: int, digits: int = 15, k: int = K, depth: int = DEPTH) -> DataFrame:
    """(query_id, doc_id, score, rank): the n best of each query by ``rrf`` of the legs, in each of which every document has a rank.

    ``queries``: (query_id); ``docs``: (doc_id), unique. Documents without a common term have score 0 and stand in the order of their ids.

    Threshold algorithm: each leg gives its ``depth`` best of a query; where it has fewer, the documents of the smallest ids come next. The
    exact ranks of what any leg gave are counted in all legs. No other document can be fused to more than the sum of
    weight / (k + depth + 1); a query whose n-th best exceeds that is done, the others go deeper. In the end everything is read.
    """
    legs = {name: leg for name, leg in legs.items() if weights[name]}
    size = docs.count()
    places = retrieval.places(docs)
    asked = store.materialise(queries.select("query_id").distinct(), "fused-queries")
    # Below documents of score 0 the order of ids tells nothing: with negative weights all is read at once.
    if any(not leg.queries.where("weight < 0").isEmpty() for leg in legs.values()):
        depth = size
    depth, done = max(depth, 4 * n), []
    while True:
        whole = depth >= size
        # In later rounds only the queries that are left.
        own = {name: leg if not done else dataclasses.replace(leg, queries=leg.queries.join(asked, "query_id", "left_semi")) for name, leg in legs.items()}
        given = [retrieval.top(products.best(leg, depth), depth).select("query_id", "doc_id", F.lit(name).alias("leg")) for name, leg in own.items()]
        given = store.materialise(reduce(DataFrame.unionByName, given), "fused-given")
        full = given.groupBy("query_id", "leg").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= depth).groupBy("query_id").agg(F.count(F.lit(1)).alias("legs")).where(F.col("legs") == len(legs))
        short = asked.join(full, "query_id", "left_anti")
        first = short.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(depth, size) - 1).cast("long"))).alias("place")).join(places, "place").select("query_id", "doc_id") if size else short.join(docs.limit(0))
        pairs = store.materialise(given.select("query_id", "doc_id").unionByName(first.select("query_id", "doc_id")).distinct(), "fused-pairs")
        parts = [(products.ranks_of(leg, pairs, places, size), weights[name]) for name, leg in own.items()]
        fused = store.materialise(retrieval.ranked(rrf(parts, k), digits=digits).where(F.col("rank") <= n), "fused-best")
        limit = sum(weights[name] / (k + depth + 1) for name in legs) + 10.0**-digits
        over = fused if whole else fused.join(fused.where((F.col("rank") == n) & (F.round("score", digits) > limit)).select("query_id"), "query_id", "left_semi")
        done.append(over)
        asked = store.materialise(asked.join(over, "query_id", "left_anti"), "fused-queries") if not whole else asked.limit(0)
        left = 0 if whole else asked.count()
        _log.info("fusion: %d entries of each leg read, %d queries left", depth, left)
        if not left:
            return reduce(DataFrame.unionByName, done)
        depth *= DEEPER


def over_max(score: str = "score", by: str = "query_id") -> Column:
    """Score over its query's largest, or over 1 if that is 0."""
    return F.col(score) / F.coalesce(F.nullif(F.max(score).over(Window.partitionBy(by)), F.lit(0.0)), F.lit(1.0))


def min_max(score: str = "score", by: str = "query_id") -> Column:
    """Score scaled to 0..1 in its query; 0 where all are the same."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-12, 0.0).otherwise((F.col(score) - low) / (high - low))


def rerank(candidates: DataFrame, scored: DataFrame | None, ce_weight: float = 1.0, k: int = K) -> DataFrame:
    """Fuse the candidates' own order with a scorer's, both ranked among the candidates, over the maximum.

    ``candidates``: (query_id, doc_id, cand_pos from 0); ``scored``: (query_id, doc_id, score) or None.
    """
    own = candidates.withColumn("rank", F.col("cand_pos") + 1)
    legs = [(own, 1.0)]
    if scored is not None:
        met = candidates.join(scored, ["query_id", "doc_id"])
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "cand_pos")
        legs.append((met.withColumn("rank", F.row_number().over(order)), ce_weight))
    fused = rrf(legs, k).withColumn("score", over_max())
    return candidates.join(fused, ["query_id", "doc_id"])


def top_stable(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each query by score, ties by candidate position; ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "cand_pos")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def clamp(rows: DataFrame, step: float = 1e-9) -> DataFrame:
    """Scores made strictly decreasing by rank: s = min(score, previous s - step), as a running minimum."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("rank") - 1
    return rows.withColumn("score", F.min(F.col("score") + place * step).over(order) - place * step)
