"""Nearest vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id, so that no vector that thousands
of rows repeat fills one shard; rows equal in id and vector are counted before that. In a shard, rows with
equal vectors are one node that knows its smallest ids. Every node has a level, falling off
geometrically, and nodes are inserted from the highest level down, at random within one: the graph that stands is searched for a
node's candidates, links are chosen among them by the usual diversity rule, and linked nodes take the
new one in, choosing anew where their lists are full. Nodes go in by batches that are searched
together, and nodes of one batch are candidates of each other. A graph is stored as flat arrays of neighbours,
one for the ground and one for each level above, whose members are its first nodes.

A block of queries searches a shard together: one step expands the nearest unexpanded node of every
query. Shard results are merged by the exact double-precision distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store

#: Rows of a shard, on average.
SHARD = 16384
#: Queries of a block, and nodes of a batch that is inserted together.
QUERIES = 512
#: Query blocks that one copy of a shard's index answers at most.
BLOCKS = 64
#: Links of a node above the ground level; twice as many on it.
LINKS = 16
#: Candidates for a node's links, and for its answer.
EF_BUILD = 64
EF_SEARCH = 256
#: Links that an overfull node chooses among at most.
CROWD = 96

_INDEX = "dim int, shard long, vectors binary, ids binary, held binary, per_node int, graphs array<binary>, widths array<int>"


def _to(q: np.ndarray, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of nodes (Q x m)."""
    diff = x[nodes] - q[:, None, :]
    return np.einsum("qmd,qmd->qm", diff, diff)


def _choose(near: np.ndarray, own: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of each row's nodes ``near`` (-1: none), at distances ``own``, up to ``most`` links (rows x most, -1: none).

    A node is taken if it is closer than to any taken before it, nearest first; what is left open
    goes to the nearest of the others.
    """
    order = np.lexsort((near, np.where(near >= 0, own, np.inf)), axis=1)
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    rows, width = near.shape
    v = x[np.maximum(near, 0)]
    norm = np.einsum("rmd,rmd->rm", v, v)
    closest = np.full((rows, width), np.inf)
    taken = np.zeros((rows, width), bool)
    for t in range(width):
        take = (near[:, t] >= 0) & (closest[:, t] > own[:, t]) & (taken.sum(1) < most)
        taken[:, t] = take
        some = np.flatnonzero(take)
        if len(some):
            apart = norm[some] + norm[some, t, None] - 2.0 * np.einsum("rmd,rd->rm", v[some], v[some, t])
            closest[some] = np.minimum(closest[some], apart)
    # Taken ones first, then by nearness; nodes that are not there last.
    rank = np.argsort(np.where(taken, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(near, rank, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def descend(q: np.ndarray, x: np.ndarray, above: list[np.ndarray]) -> np.ndarray:
    """For each query the node where a walk through the graphs ``above`` (lowest first) ends."""
    at = np.zeros(len(q), np.int64)
    best = _to(q, x, at[:, None])[:, 0]
    for links in reversed(above):
        moving = np.arange(len(q))
        while len(moving):
            near = links[at[moving]]
            nodes = np.maximum(near, 0)
            dist = np.where(near >= 0, _to(q[moving], x, nodes), np.inf)
            k = dist.argmin(1)
            rows = np.arange(len(moving))
            better = dist[rows, k] < best[moving]
            at[moving[better]] = nodes[rows, k][better]
            best[moving[better]] = dist[rows, k][better]
            moving = moving[better]
    return at


def search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query ``ef`` near nodes of the graph, nearest first, and their squared distances (-1, inf: none)."""
    n_q = len(q)
    ids, dist, done = np.full((n_q, ef), -1, np.int64), np.full((n_q, ef), np.inf), np.ones((n_q, ef), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, _to(q, x, start[:, None])[:, 0], False
    visited = np.zeros((n_q, len(graph) + 1), bool)
    visited[np.arange(n_q), start] = True
    visited[:, -1] = True  # where a link that is not there, -1, points
    live = np.arange(n_q)
    while True:
        ahead = np.where(done[live], np.inf, dist[live])
        k = ahead.argmin(1)
        going = np.isfinite(ahead[np.arange(len(live)), k])
        live, k = live[going], k[going]
        if not len(live):
            break
        done[live, k] = True
        nodes = graph[ids[live, k]].astype(np.int64)
        new = ~visited[live[:, None], nodes]
        visited[live[:, None], nodes] = True
        found = np.where(new, _to(q[live], x, nodes), np.inf)
        all_dist = np.concatenate([dist[live], found], 1)
        keep = np.argpartition(all_dist, ef - 1, axis=1)[:, :ef]
        dist[live] = np.take_along_axis(all_dist, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], nodes], 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), keep, 1)
    order = np.lexsort((ids, dist), axis=1)
    dist = np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), np.take_along_axis(ids, order, 1), -1), dist


def graph(x: np.ndarray, above: list[np.ndarray], most: int, batch: int = QUERIES) -> np.ndarray:
    """Neighbour lists (len(x) x most, -1: none) of nodes that are inserted in order; ``above``: finished graphs over the first nodes."""
    out = np.full((len(x), most), -1, np.int32)
    at = 0
    while at < len(x):
        # The first batches are no larger than what stands.
        stop = min(len(x), at + min(batch, max(32, at)))
        new = np.arange(at, stop)
        q = x[new]
        # Of its own batch a node sees those before it.
        norm = np.einsum("nd,nd->n", q, q)
        inner = np.maximum(norm[:, None] + norm[None] - 2.0 * (q @ q.T), 0.0)
        inner[np.triu_indices(len(new))] = np.inf
        first = np.argsort(inner, axis=1, kind="stable")[:, :EF_BUILD]
        own = np.take_along_axis(inner, first, 1)
        near = np.where(np.isfinite(own), first + at, -1)
        if at:
            # Upper graphs hold nodes up to some place; only those that stand already can be a start.
            ids, dist = search(q, x, out[:at], descend(q, x, [g for g in above if len(g) <= at]), EF_BUILD)
            near, own = np.concatenate([ids, near], 1), np.concatenate([dist, own], 1)
            order = np.argsort(own, axis=1, kind="stable")[:, :EF_BUILD]
            near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        links = _choose(near, own, x, most // 2 if most > LINKS else most)
        out[new, : links.shape[1]] = links
        _take_in(out, x, new, links)
        at = stop
    return out


def _take_in(out: np.ndarray, x: np.ndarray, new: np.ndarray, links: np.ndarray) -> None:
    """Link the ends of the new nodes' links back."""
    most = out.shape[1]
    source = np.repeat(new, (links >= 0).sum(1))
    target = links[links >= 0].astype(np.int64)
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    nodes, first, times = np.unique(target, return_index=True, return_counts=True)
    held = (out[nodes] >= 0).sum(1)
    for full in (False, True):
        some = np.flatnonzero((held + times > most) == full)
        for part in np.array_split(some, max(1, len(some) // 512 + 1)):
            if not len(part):
                continue
            width = int(times[part].max())
            place = np.arange(width)[None, :]
            added = np.where(place < times[part, None], source[np.minimum(first[part, None] + place, len(source) - 1)], -1)
            both = np.concatenate([out[nodes[part]].astype(np.int64), added], 1)
            if not full:
                packed = np.argsort(both < 0, axis=1, kind="stable")[:, :most]
                out[nodes[part]] = np.take_along_axis(both, packed, 1)
                continue
            dist = np.where(both >= 0, _to(x[nodes[part]], x, np.maximum(both, 0)), np.inf)
            if both.shape[1] > CROWD:
                near = np.argsort(dist, axis=1, kind="stable")[:, :CROWD]
                both, dist = np.take_along_axis(both, near, 1), np.take_along_axis(dist, near, 1)
            out[nodes[part]] = _choose(both, dist, x, most)


def build(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order in which the rows of ``x`` become nodes, and the graphs over them, ground first."""
    level = np.floor(-np.log(1.0 - rng.random(len(x))) / math.log(LINKS)).astype(int)
    order = np.lexsort((rng.permutation(len(x)), -level))
    x, level = x[order], level[order]
    above: list[np.ndarray] = []
    for h in range(int(level.max()), -1, -1):
        above.insert(0, graph(x[: int((level >= h).sum())], above, 2 * LINKS if h == 0 else LINKS))
    return order, above


def builder(keep: int):
    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        nodes, node_of = np.unique(x, axis=0, return_inverse=True)
        order, graphs = build(nodes, np.random.default_rng(int(key[1]) + 1))
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        owned = np.full((len(nodes), keep), -1, np.int64)
        filled = np.zeros(len(nodes), np.int64)
        for i, times, node in zip(rows["vec_id"].tolist(), rows["times"].tolist(), where[node_of.reshape(-1)].tolist(), strict=True):  # ids rise
            more = min(times, keep - filled[node])
            owned[node, filled[node] : filled[node] + more] = i
            filled[node] += more
        made = (int(key[0]), int(key[1]), nodes[order].tobytes(), owned.tobytes(), filled.tobytes(), keep, [g.tobytes() for g in graphs], [g.shape[1] for g in graphs])
        return pd.DataFrame([made], columns=["dim", "shard", "vectors", "ids", "held", "per_node", "graphs", "widths"])

    return shard


def searcher(k: int, ef: int):
    """Answers of the query blocks that follow a shard's index row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.vectors is not None:
                    x = np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
                    owned = np.frombuffer(row.ids, np.int64).reshape(len(x), -1)
                    held = np.frombuffer(row.held, np.int64)
                    graphs = [np.frombuffer(g, np.int32).reshape(-1, w) for g, w in zip(row.graphs, row.widths, strict=True)]
                    continue
                asked = np.frombuffer(row.asked, np.int64)
                q = np.frombuffer(row.queries, np.float64).reshape(-1, row.dim)
                near, far = search(q, x, graphs[0], descend(q, x, graphs[1:]), min(ef, len(x)))
                out = []
                for own, query, nodes, dist in zip(asked.tolist(), q, near, far, strict=True):
                    nodes = nodes[np.isfinite(dist)]
                    exact = np.sqrt(((x[nodes] - query) ** 2).sum(1))
                    pairs = sorted((s, i) for s, n in zip(exact.tolist(), nodes, strict=True) for i in owned[n, : held[n]].tolist())
                    if (0.0, own) in pairs:  # the query's own row; others of its id are candidates
                        pairs.remove((0.0, own))
                    out += [(own, i, s) for s, i in pairs[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose vec_id ``every`` divides.

    ``vectors``: vec_id and embedding (an array of numbers, of any length); more columns are ignored. Rows without a
    vec_id, and vectors that are null, empty, zero or hold null or non-finite components take no part.
    Vectors are compared with those of their own length. Rows that share a vec_id are all candidates, equal
    ones too; as a query the smallest vector of a vec_id stands for it, and only that row is its own. Ties go
    to the smaller vec_id. Fewer candidates than k give fewer rows, empty tables an empty result.
    """
    spark = vectors.sparkSession
    vector = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    # -0.0 and 0.0 are one number.
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda v: v + F.lit(0.0)).alias("vector"))
    rows = rows.where(finite & F.exists("vector", lambda v: v != 0)).groupBy(F.size("vector").alias("dim"), "vec_id", "vector").agg(F.count(F.lit(1)).alias("times"))
    with store.scratch(spark):
        rows = store.materialise(rows, "hnsw-rows")
        counted = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"))
        counted = counted.select("dim", F.greatest(F.lit(1), F.ceil(F.col("rows") / shard_rows)).cast("long").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("rows") / every / QUERIES)).cast("long").alias("blocks"))
        counted = store.materialise(counted.withColumn("ways", F.ceil(F.col("blocks") / BLOCKS).cast("long")), "hnsw-dims")
        total = counted.agg(F.sum(F.col("shards")), F.sum(F.col("shards") * F.col("ways"))).first()
        n_shards, n_parts = int(total[0] or 0), int(total[1] or 0)
        if not n_shards:
            return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        dealt = rows.join(F.broadcast(counted), "dim")  # a row for each vector length
        spot = F.pmod(F.xxhash64(F.lit(7), "vec_id", "vector"), F.col("shards"))
        grouped = dealt.select("dim", "vec_id", "vector", "times", spot.alias("shard")).repartition(n_shards, "dim", "shard").groupBy("dim", "shard")
        index = store.materialise(grouped.applyInPandas(builder(k + 1), _INDEX), "hnsw-index")

        asked = dealt.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("dim", "vec_id", "shards", "blocks", "ways").agg(F.min("vector").alias("vector"))
        asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(8), "vec_id"), F.col("blocks")))

        def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            q = np.stack(rows["vector"].to_numpy()).astype(np.float64)
            made = (int(key[0]), int(key[1]), int(rows["shards"].iat[0]), int(rows["ways"].iat[0]), rows["vec_id"].to_numpy(np.int64).tobytes(), q.tobytes())
            return pd.DataFrame([made], columns=["dim", "block", "shards", "ways", "asked", "queries"])

        packed = store.materialise(asked.groupBy("dim", "block").applyInPandas(pack, "dim int, block long, shards long, ways long, asked binary, queries binary"), "hnsw-queries")
        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        copies = index.join(F.broadcast(counted.select("dim", "ways")), "dim").withColumn("way", numbers("ways")).drop("ways").withColumn("block", F.lit(-1).cast("long"))
        blocks = packed.withColumn("way", F.pmod("block", F.col("ways"))).withColumn("shard", numbers("shards")).drop("shards", "ways")
        # A shard's index goes to a task once, before the query blocks that it answers.
        met = copies.unionByName(blocks, allowMissingColumns=True).repartition(n_parts, "dim", "shard", "way").sortWithinPartitions("dim", "shard", "way", "block")
        found = store.materialise(met.mapInPandas(searcher(k, ef), "query_id long, vec_id long, score double"), "hnsw-found", records=4)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return store.kept(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "hnsw-answers")
