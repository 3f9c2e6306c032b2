"""The nearest of many vectors by cosine, exactly, without meeting all of them.

Documents stand in blocks around pivots, a bounded number of vectors among them; a pivot knows the largest angle at which one of its documents
stands. By the triangle inequality no document of a pivot is nearer to a query than the query's angle to the pivot less that angle. A
query first meets one block of its own pivot; its k-th best cosine there decides which other blocks it has to meet, and all others are skipped.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from .retrieval import top, unit_vector

# What runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pivots at most, documents of a block and queries that meet it at once, about.
PIVOTS, DOC_BLOCK, QUERY_BLOCK = 1024, 2048, 512
SLACK = 1e-8
#: The pivot of zero vectors, whose cosine is 0 with everything.
ZERO = -1

_log = logging.getLogger(__name__)


class Pivots:
    """Pivots, and for each that has documents its blocks and the smallest cosine of a document with it."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.names, self.blocks, self.least = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, cosine) of unit vectors; zero vectors have their own."""
        if not len(self.vectors):
            return np.full(len(v), ZERO), np.zeros(len(v))
        cos = v @ self.vectors.T
        own = np.where(v.any(axis=1), cos.argmax(axis=1), ZERO)
        return own, np.where(own == ZERO, 0.0, cos.max(axis=1))

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """(vectors x named pivots): the largest cosine that a document of the pivot can have with the vector."""
        out = np.zeros((len(v), len(self.names)))
        real = self.names != ZERO
        if real.any():
            angle = np.arccos(np.clip(v @ self.vectors[self.names[real]].T, -1, 1)) - np.arccos(np.clip(self.least[real], -1, 1))
            out[:, real] = np.where(v.any(axis=1)[:, None], np.cos(np.maximum(angle, 0.0)), 0.0)
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _meet(asked: DataFrame, blocks: DataFrame, salts: int, k: int, digits: int, kinds: tuple[str, str]) -> DataFrame:
    """(query_id, doc_id, score): the k best documents of each block for the queries (id, v, pivot, sub) that ask for it."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                d_ids = np.asarray(row.d_ids)
                order = np.argsort(d_ids, kind="stable")
                docs = np.asarray(row.d_vectors).reshape(len(d_ids), -1)[order]
                q_ids, q = np.asarray(row.q_ids), np.asarray(row.q_vectors).reshape(len(row.q_ids), -1)
                for a in range(0, len(q_ids), QUERY_BLOCK):
                    scores = q[a : a + QUERY_BLOCK] @ docs.T
                    first = np.argsort(-scores.round(digits), axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(q_ids[a : a + QUERY_BLOCK], first.shape[1]), "doc_id": d_ids[order][first.reshape(-1)], "score": np.take_along_axis(scores, first, 1).reshape(-1)})

    rows = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).groupBy("pivot", "sub", "salt").agg(F.collect_list(F.struct("id", "v")).alias("q"))
    rows = rows.select("pivot", "sub", "salt", F.col("q.id").alias("q_ids"), F.flatten("q.v").alias("q_vectors"))
    given = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    # Never by a broadcast: repeated vectors are few bytes in the file and many in memory.
    pairs = given.join(rows.hint("merge"), ["pivot", "sub", "salt"]).select("d_ids", "d_vectors", "q_ids", "q_vectors")
    return store.materialise(pairs.mapInPandas(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"), "dense-best", records=1)


def dense_top(queries: DataFrame, docs: DataFrame, k: int = 10, doc_block: int = DOC_BLOCK, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, rank, score): the k best of ``docs`` by cosine for every query; both sides are (id, vector) of one length.

    Ties, after rounding, go to the smaller doc_id. Zero vectors have cosine 0; null vectors take no part.
    """
    kinds = dict(queries.dtypes)["id"], dict(docs.dtypes)["id"]
    unit = lambda side, label: store.materialise(side.where("vector is not null").select("id", unit_vector(F.col("vector")).alias("v")), label)
    given, asked = unit(docs, "dense-docs"), unit(queries, "dense-queries")
    n, m = given.count(), asked.count()
    chosen = given.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id", "v"), "id").limit(min(PIVOTS, -(-n // doc_block))).collect()
    pivots = Pivots(_matrix(pd.Series([r.v for r in chosen])))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, near = pivots.nearest(_matrix(b["v"]))
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "pivot": own, "near": near})

    dealt = store.materialise(given.mapInPandas(deal, f"id {kinds[1]}, v array<double>, pivot long, near double"), "dense-dealt")
    per = dealt.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / doc_block).alias("subs"), F.min("near").alias("least"))  # no more rows than pivots
    known = per.orderBy("pivot").collect()
    pivots.names, pivots.blocks, pivots.least = np.array([r.pivot for r in known], np.int64), np.array([r.subs for r in known], np.int64), np.array([r.least for r in known])
    placed = dealt.join(F.broadcast(per.select("pivot", "subs")), "pivot").withColumn("sub", F.pmod(F.xxhash64("id", "v"), F.col("subs")))
    packed = placed.groupBy("pivot", "sub").agg(F.collect_list(F.struct("id", "v")).alias("d"))
    blocks = store.materialise(packed.select("pivot", "sub", F.col("d.id").alias("d_ids"), F.flatten("d.v").alias("d_vectors")), "dense-blocks", records=1)
    salts = max(1, -(-m // (32 * QUERY_BLOCK)))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _matrix(b["v"])
            best = pivots.bounds(v).argmax(axis=1) if len(pivots.names) and len(v) else np.zeros(len(v), np.int64)
            if len(pivots.names):
                # Any block of the pivot will do: queries spread over them.
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "pivot": pivots.names[best], "sub": np.arange(len(v)) % pivots.blocks[best]})

    homes = store.materialise(asked.mapInPandas(home, f"id {kinds[0]}, v array<double>, pivot long, sub long"), "dense-homes")
    first = _meet(homes, blocks, salts, k, digits, kinds)
    reached = top(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.round("score", digits).alias("least"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            wanted = pivots.bounds(_matrix(b["v"])) >= b["least"].fillna(-np.inf).to_numpy()[:, None] - SLACK
            q, p = np.nonzero(wanted)
            subs = pivots.blocks[p]
            q, p = np.repeat(q, subs), np.repeat(p, subs)
            sub = np.arange(len(q)) - np.repeat(np.cumsum(subs) - subs, subs)
            new = ~((pivots.names[p] == b["pivot"].to_numpy()[q]) & (sub == b["sub"].to_numpy()[q]))
            yield pd.DataFrame({"id": b["id"].to_numpy()[q[new]], "v": b["v"].to_numpy()[q[new]], "pivot": pivots.names[p[new]], "sub": sub[new]})

    more = store.materialise(homes.join(reached, "id", "left").mapInPandas(others, f"id {kinds[0]}, v array<double>, pivot long, sub long"), "dense-others")
    _log.info("cosine: %d of %d meetings of a query with a block skipped", m * int(pivots.blocks.sum()) - m - more.count(), m * int(pivots.blocks.sum()))
    return top(first.unionByName(_meet(more, blocks, salts, k, digits, kinds)), k)
