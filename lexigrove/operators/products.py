"""The best of sparse products, and ranks in them, without a row for every pair that shares a term.

A ``Leg`` scores a pair by the sum over common terms of the query's weight times the document's. The queries' vectors are held
by term, a bounded number of entries at a time, and go to every task; the documents pass by in chunks, as the rows of
``terms.vectors`` or, where a leg has only single entries, dealt by document and sorted. Rows that leave a task are at most k a query, whatever the documents have in common with it.

A chunk's largest weight of a term bounds what the term can add to a score in it. The terms of a query that together cannot lift a
document over its k-th best score so far are left out at first (common words, mostly), all of them where the whole
chunk cannot; only documents that the other terms bring close enough are scored in full. Nothing is lost: the result is exact.

Where the held vectors fit a table of terms and queries (``TABLE``) and the documents have many entries for it, a chunk's scores are a product of
matrices instead: its documents as rows of such terms, many more of them at once. Terms that few of its documents or few queries have (``THICK``) stay entries.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from .terms import RECORDS, unpacked

# What runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries of queries' vectors that are held at once, about; more are worked off in groups of queries.
HELD = 1 << 20
#: Entries of documents that are put together before they are cut into chunks.
ENTRIES = 1 << 18
#: Cells and products of a chunk, about.
CELLS = 1 << 21
#: Most cells of a table of held terms and queries, and how many of its products take the time of one of entries, about.
TABLE, CHEAP = 1 << 23, 300
#: A term is a column of such a matrix if it has more products than this for each document of the chunk.
THICK = 0.7
#: Scores are compared after rounding to so many digits, so that sums in another order agree.
DIGITS = 9
SLACK = 1e-8


@dataclass(frozen=True)
class Leg:
    """``queries``: (query_id, term, weight, factor), written; ``docs``: (doc_id, term, weight), written; ``scales``: (doc_id, scale).

    A document's weight is ``scaled(weight * factor, scale)``: ``factor`` belongs to the term, ``scale`` to the document.
    ``vectors``, if given, are the documents once more, a row each (``terms.vectors``), with ``weighed(tf)`` for the weight; the queries' rows then have the
    terms' numbers ``t``.
    """

    queries: DataFrame
    docs: DataFrame
    scales: DataFrame
    scaled: Callable[[np.ndarray, np.ndarray], np.ndarray]
    vectors: DataFrame | None = None
    weighed: Callable[[np.ndarray], np.ndarray] | None = None


class Held:
    """Vectors of some queries by term."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("query_id").combine_chunks().dictionary_encode()
        terms = rows.column("term").combine_chunks().dictionary_encode()
        self.ids, self.terms = ids.dictionary, terms.dictionary
        t, q = terms.indices.to_numpy(), ids.indices.to_numpy()
        order = np.lexsort((q, t))
        self.q, self.t, self.w = q[order].astype(np.int64), t[order].astype(np.int64), rows.column("weight").to_numpy()[order]
        self.starts = np.searchsorted(self.t, np.arange(len(self.terms) + 1))
        self.factor = np.ones(len(self.terms))
        self.factor[t] = rows.column("factor").to_numpy()
        if "t" in rows.column_names:
            self.number = np.empty(len(self.terms), np.int64)
            self.number[t] = rows.column("t").to_numpy()

    @functools.cached_property
    def place(self) -> np.ndarray:
        """The place of the term of each number among the held ones, -1 where it is not held; the last is that of all larger numbers."""
        out = np.full(int(self.number.max(initial=-1)) + 2, -1, np.int32)
        out[self.number] = np.arange(len(self.number))
        return out

    @functools.cached_property
    def table(self) -> np.ndarray:
        """(terms x queries), of the weights."""
        return np.bincount(self.t * len(self.ids) + self.q, self.w, len(self.terms) * len(self.ids)).reshape(len(self.terms), len(self.ids))

    @functools.cached_property
    def there(self) -> np.ndarray:
        """(terms x queries): 1 where a query has the term, whatever its weight."""
        out = np.zeros((len(self.terms), len(self.ids)), np.float32)
        out[self.t, self.q] = 1
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "there", "place")}  # made anew where they are wanted

    def numbers(self, like: DataFrame) -> DataFrame:
        """(term, t, factor) for a join with the documents; at most as many rows as are held."""
        return like.sparkSession.createDataFrame(pa.table({"term": self.terms, "t": np.arange(len(self.terms), dtype=np.int32), "factor": self.factor}))


class Chunk:
    """Whole documents, by id, and their entries."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, t: np.ndarray, w: np.ndarray, dense: bool = False):
        self.ids, self.doc, self.t, self.w, self.dense = ids, doc, t, w, dense

    def products(self, held: Held, starts: np.ndarray | None = None, place: np.ndarray | None = None, only: np.ndarray | None = None, touched: np.ndarray | None = None) -> np.ndarray:
        """Scores (documents x queries). ``starts``, ``place``: a part of the held entries by term; ``only``: numbers of documents.

        ``touched``: cells of a pair with a common term are set in it.
        """
        doc, t, w, n = self.doc, self.t, self.w, len(self.ids)
        if only is not None:
            row = np.full(n, -1)
            row[only] = np.arange(len(only))
            own = np.flatnonzero(row[doc] >= 0)
            doc, t, w, n = row[doc[own]], t[own], w[own], len(only)
        made = 0.0
        if self.dense and place is None:
            thick = np.bincount(t, minlength=len(held.terms)) * np.diff(held.starts) > THICK * n
            columns = np.flatnonzero(thick)
            own = thick[t]
            cell = doc[own] * len(columns) + (np.cumsum(thick) - 1)[t[own]]
            rows = np.zeros(n * len(columns))
            rows[cell] = w[own]  # a document has a term once
            made = rows.reshape(n, len(columns)) @ held.table[columns]
            if touched is not None:
                seen = np.zeros(n * len(columns), np.float32)
                seen[cell] = 1
                touched |= seen.reshape(n, len(columns)) @ held.there[columns] > 0
            doc, t, w = doc[~own], t[~own], w[~own]
        starts = held.starts if starts is None else starts
        times = starts[t + 1] - starts[t]
        total = np.cumsum(times)
        at = np.repeat(starts[t] - total + times, times) + np.arange(total[-1] if len(total) else 0)
        if place is not None:
            at = place[at]
        cell = np.repeat(doc * len(held.ids), times) + held.q[at]
        if touched is not None:
            touched.reshape(-1)[cell] = True
        more = np.bincount(cell, np.repeat(w, times) * held.w[at], n * len(held.ids))
        return more.astype(np.float64, copy=False).reshape(n, len(held.ids)) + made  # of nothing it is a count


def _parted(own: np.ndarray, doc: np.ndarray, t: np.ndarray, w: np.ndarray, held: Held) -> Iterator[Chunk]:
    """Chunks of the documents ``own`` with entries by document."""
    # What a document costs: its cells, and the products of its entries.
    made = np.bincount(doc, held.starts[t + 1] - held.starts[t], len(own))
    table = len(held.terms) * len(held.ids)
    dense = table <= TABLE and table * len(own) < CHEAP * made.sum()
    cost = np.full(len(own), (len(held.terms) + len(held.ids)) / 8) if dense else made + len(held.ids)
    part = (np.cumsum(cost) // CELLS).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(own)]])
    ends = np.searchsorted(doc, edges)
    for a, b, i, j in zip(edges[:-1], edges[1:], ends[:-1], ends[1:], strict=True):
        yield Chunk(own[a:b], doc[i:j] - a, t[i:j], w[i:j], dense)


def vector_chunks(batches: Iterator[pa.RecordBatch], held: Held, scaled: Callable[[np.ndarray, np.ndarray], np.ndarray], weighed: Callable[[np.ndarray], np.ndarray]) -> Iterator[Chunk]:
    """Chunks of documents from rows (doc_id, scale, t, tf), a document each; within a chunk they are in the order of their ids."""
    for whole in batches:
        for begin in range(0, whole.num_rows, RECORDS):
            batch = whole.slice(begin, RECORDS)
            ids, scale = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            given, each = unpacked(batch.column(2))
            doc = np.repeat(np.arange(len(ids)), each)
            place = held.place[np.minimum(given, len(held.place) - 1)]
            w = weighed(unpacked(batch.column(3))[0])
            if len(place) and place.min() < 0:
                met = np.flatnonzero(place >= 0)
                doc, place, w = doc[met], place[met], w[met]
            t = place.astype(np.int64)
            w = scaled(w * held.factor[t], scale[doc])
            order = np.argsort(ids, kind="stable")
            if (order[1:] < order[:-1]).any():
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                by = np.argsort(rank[doc], kind="stable")
                ids, doc, t, w = ids[order], rank[doc][by], t[by], w[by]
            yield from _parted(ids, doc, t, w, held)


def chunks(batches: Iterator[pa.RecordBatch], held: Held, scaled: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[Chunk]:
    """Chunks of documents from rows (doc_id, t, w) by doc_id; t = -1 is a document's scale, which comes first."""
    waiting: list[tuple[np.ndarray, ...]] = []
    n = 0

    def cut(ids: np.ndarray, t: np.ndarray, w: np.ndarray) -> Iterator[Chunk]:
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        doc = np.cumsum(first) - 1
        own, scale = ids[first], np.ones(doc[-1] + 1)
        scale[doc[t < 0]] = w[t < 0]
        keep = t >= 0
        doc, t, w = doc[keep], t[keep].astype(np.int64), w[keep]
        yield from _parted(own, doc, t, scaled(w, scale[doc]), held)

    for batch in batches:
        if batch.num_rows:
            waiting.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)))
            n += batch.num_rows
        if n >= ENTRIES:
            ids, t, w = (np.concatenate(x) for x in zip(*waiting, strict=True))
            whole = np.flatnonzero(ids != ids[-1])
            stop = whole[-1] + 1 if len(whole) else 0
            if stop:
                yield from cut(ids[:stop], t[:stop], w[:stop])
            waiting, n = [(ids[stop:], t[stop:], w[stop:])], len(ids) - stop
    if n:
        yield from cut(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


class Best:
    """The k best documents of each query so far; of equal scores those of smaller ids."""

    def __init__(self, held: Held, k: int):
        self.held, self.k = held, k
        self.least = np.full(len(held.ids), -np.inf)  # a query's k-th best score
        self.q, self.score, self.doc = np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        self.skipped = self.seen = 0  # (chunk, query) pairs that no document was scored for, and all
        self.wait = self.waited = 0  # chunks of matrices that go unbounded after bounds that were of no use

    def add(self, chunk: Chunk) -> None:
        held, n = self.held, len(self.held.ids)
        unbounded = chunk.dense and self.waited < self.wait
        if not unbounded:
            largest = np.zeros(len(held.terms))
            np.maximum.at(largest, chunk.t, chunk.w)
            bound = np.maximum(held.w, 0.0) * largest[held.t]
        if unbounded:
            rest, asked, self.waited = 0.0, np.ones(n, bool), self.waited + 1
        elif chunk.dense:
            rest, asked = 0.0, np.bincount(held.q, bound, n) >= self.least - SLACK
            self.wait, self.waited = min(2 * self.wait + 1, 63) if asked.all() else 0, 0
        else:
            # A query's entries by bound: those whose sum stays below its k-th best score wait.
            order = np.lexsort((bound, held.q))
            total = np.cumsum(bound[order])
            ends = np.searchsorted(held.q[order], np.arange(n), "right")
            before = np.concatenate([[0.0], total])[np.concatenate([[0], ends[:-1]])]
            inside = total - before[held.q[order]]
            waits = inside < (self.least - SLACK)[held.q[order]]
            rest = np.zeros(n)
            np.maximum.at(rest, held.q[order][waits], inside[waits])
            active = np.ones(len(held.q), bool)
            active[order[waits]] = False
            asked = np.bincount(held.q[active], minlength=n) > 0
        self.seen += n
        self.skipped += int(n - asked.sum())
        if not asked.any():
            return
        # Where a score of 0 may be among the best, a pair must be known to have a common term.
        touched = np.zeros((len(chunk.ids), n), bool) if (self.least <= SLACK).any() else None
        whole = chunk.dense or active.all()
        if whole:
            found = chunk.products(held, touched=touched)
        else:
            starts = np.concatenate([[0], np.cumsum(active)])[held.starts]
            found = chunk.products(held, starts, np.flatnonzero(active), touched=touched)
        near = found + rest >= self.least - SLACK
        near &= asked
        if touched is not None:
            near &= touched | (self.least > SLACK)
        d, q = np.nonzero(near)
        if not whole:
            own, row = np.unique(d, return_inverse=True)
            score = chunk.products(held, only=own)[row, q] if len(own) else np.empty(0)
        else:
            score = found[d, q]
        if len(d):
            self._keep(q, score, d, chunk.ids)

    def _keep(self, q: np.ndarray, score: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        doc = np.concatenate([self.doc, ids[d]]) if len(self.doc) else ids[d]
        place = doc if doc.dtype != object else np.unique(doc, return_inverse=True)[1]
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        by = np.lexsort((place, -score.round(DIGITS), q))
        q, score, doc = q[by], score[by], doc[by]
        first = np.searchsorted(q, np.arange(len(self.held.ids) + 1))
        rank = np.arange(len(q)) - first[q]
        keep = rank < self.k
        self.q, self.score, self.doc = q[keep], score[keep], doc[keep]
        last = rank == self.k - 1
        self.least[q[last]] = score[last].round(DIGITS)


def groups(leg: Leg) -> Iterator[Held]:
    """The queries' vectors, as many at a time as are held."""
    parts = max(1, -(-leg.queries.count() // HELD))
    for part in range(parts):
        some = leg.queries if parts == 1 else leg.queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        more = [] if leg.vectors is None else ["t"]
        rows = some.select("query_id", "term", F.col("weight").cast("double").alias("weight"), F.col("factor").cast("double").alias("factor"), *more).toArrow()
        if rows.num_rows:
            yield Held(rows)


def _entries(leg: Leg, held: Held, only: DataFrame | None = None) -> DataFrame:
    """The leg's ``vectors``; without them (doc_id, t, w) of the documents' entries that a held query has, and each document's scale as t = -1, by document."""
    if leg.vectors is not None:
        return leg.vectors if only is None else leg.vectors.join(F.broadcast(only), "doc_id", "left_semi")
    docs, scales = leg.docs, leg.scales
    if only is not None:
        docs, scales = docs.join(only, "doc_id", "left_semi"), scales.join(only, "doc_id", "left_semi")
    numbers = F.broadcast(held.numbers(docs))  # no more than HELD rows
    met = docs.join(numbers, "term").select("doc_id", "t", (F.col("weight") * F.col("factor")).alias("w"))
    rows = met.unionByName(scales.select("doc_id", F.lit(-1).alias("t"), F.col("scale").cast("double").alias("w")))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "t")


def _reader(leg: Leg) -> Callable[[Iterator[pa.RecordBatch], Held], Iterator[Chunk]]:
    """Chunks of what ``_entries`` gives; holds no frame, so that it can travel."""
    scaled, weighed = leg.scaled, leg.weighed
    if leg.vectors is None:
        return lambda batches, held: chunks(batches, held, scaled)
    return lambda batches, held: vector_chunks(batches, held, scaled, weighed)


def _records(leg: Leg) -> int | None:
    """Most rows of a batch, where a row is a whole document."""
    return None if leg.vectors is None else RECORDS


def _types(leg: Leg) -> str:
    return f"query_id {dict(leg.queries.dtypes)['query_id']}, doc_id {dict(leg.docs.dtypes)['doc_id']}"


def _schema(frame: DataFrame, names: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.select(*names).schema)


def _union(frames: list[DataFrame], leg: Leg, more: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else leg.docs.sparkSession.createDataFrame([], f"{_types(leg)}, {more}")


def best(leg: Leg, k: int, label: str = "best") -> DataFrame:
    """(query_id, doc_id, score), written: the k best of each query in every part of the documents, the k best of all among them.

    Only pairs with a common term. Of equal scores, after rounding, those of smaller ids.
    """
    read, found = _reader(leg), []
    id_type = _schema(leg.docs, ["doc_id"]).field(0).type
    for held in groups(leg):

        def search(batches: Iterator[pa.RecordBatch], held: Held = held) -> Iterator[pa.RecordBatch]:
            state = Best(held, k)
            for chunk in read(batches, held):
                state.add(chunk)
            yield pa.RecordBatch.from_arrays([held.ids.take(pa.array(state.q)), pa.array(state.doc.tolist(), id_type), pa.array(state.score)], ["query_id", "doc_id", "score"])

        found.append(store.materialise(_entries(leg, held).mapInArrow(search, f"{_types(leg)}, score double"), label, _records(leg)))
    return _union(found, leg, "score double")


def best_of_each(leg: Leg, k: int, label: str = "best-of-each") -> DataFrame:
    """(query_id, doc_id, score), written: the other way round, the k best queries of each document, from every group of held ones.

    For many documents that meet a bounded number of texts: each document's rows come from one task. Only pairs with
    a common term. Of equal scores, after rounding, those of smaller query ids.
    """
    read, found = _reader(leg), []
    id_type = _schema(leg.docs, ["doc_id"]).field(0).type
    for held in groups(leg):

        def choose(batches: Iterator[pa.RecordBatch], held: Held = held) -> Iterator[pa.RecordBatch]:
            ids = held.ids.to_numpy(zero_copy_only=False)
            place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # in the order of ids
            few = min(k, len(ids))
            for chunk in read(batches, held):
                touched = np.zeros((len(chunk.ids), len(ids)), bool)
                score = chunk.products(held, touched=touched)
                down = np.where(touched, -score.round(DIGITS), np.inf)
                d, q = np.nonzero(touched & (down <= np.partition(down, few - 1, axis=1)[:, few - 1 : few]))
                by = np.lexsort((place[q], down[d, q], d))
                d, q = d[by], q[by]
                keep = np.arange(len(d)) - np.searchsorted(d, d) < k
                d, q = d[keep], q[keep]
                yield pa.RecordBatch.from_arrays([held.ids.take(pa.array(q)), pa.array(chunk.ids[d].tolist(), id_type), pa.array(score[d, q])], ["query_id", "doc_id", "score"])

        found.append(store.materialise(_entries(leg, held).mapInArrow(choose, f"{_types(leg)}, score double"), label, _records(leg)))
    return _union(found, leg, "score double")


def ranks_of(leg: Leg, pairs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(query_id, doc_id, score, rank), written: the pairs' ranks among all documents, those of score 0 included.

    ``pairs``: (query_id, doc_id), distinct, a bounded number a query; ``places``: (doc_id, place), a document's number in the order of
    ids, from 0; ``size``: how many there are. The pairs are scored first; then the documents pass by and each task counts those that come before a
    pair. No task and no window holds the documents of one query.
    """
    read, found = _reader(leg), []
    only = store.materialise(pairs.select("doc_id").distinct(), "pair-docs")
    for held in groups(leg):
        mine = pairs.join(F.broadcast(pairs.sparkSession.createDataFrame(pa.table({"query_id": held.ids}))), "query_id")
        asked = mine.select("query_id", "doc_id").toArrow()  # a bounded number for each held query
        q = pa.compute.index_in(asked.column("query_id"), value_set=held.ids).to_numpy().astype(np.int64)
        ids = asked.column("doc_id").to_numpy(zero_copy_only=False) if asked.num_rows else np.empty(0, object)
        by = np.lexsort((ids, q))
        q, ids = q[by], ids[by]
        first = np.searchsorted(q, np.arange(len(held.ids) + 1))

        def scores(batches: Iterator[pa.RecordBatch], held: Held = held, q=q, ids=ids) -> Iterator[pa.RecordBatch]:
            for chunk in read(batches, held):
                at = np.minimum(np.searchsorted(chunk.ids, ids), len(chunk.ids) - 1)
                here = np.flatnonzero(chunk.ids[at] == ids)
                own, row = np.unique(at[here], return_inverse=True)
                made = chunk.products(held, only=own)[row, q[here]] if len(own) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(made)], ["pair", "score"])

        scored = np.zeros(len(q))
        rows = _entries(leg, held, only).mapInArrow(scores, "pair long, score double").toArrow()
        scored[rows.column("pair").to_numpy()] = rows.column("score").to_numpy()
        near = scored.round(DIGITS)

        def count(batches: Iterator[pa.RecordBatch], held: Held = held, q=q, ids=ids, near=near, first=first) -> Iterator[pa.RecordBatch]:
            above, before, nonzero = (np.zeros(len(q), np.int64) for _ in range(3))
            for chunk in read(batches, held):
                table = chunk.products(held).round(DIGITS)
                for k in range(len(held.ids)):
                    a, b = first[k], first[k + 1]
                    own = np.flatnonzero(table[:, k])
                    if a == b or not len(own):
                        continue
                    down = -table[own, k]
                    order = np.argsort(down, kind="stable")
                    low, high = np.searchsorted(down[order], -near[a:b]), np.searchsorted(down[order], -near[a:b], "right")
                    place = np.searchsorted(chunk.ids[own], ids[a:b])
                    above[a:b] += low
                    for i in np.flatnonzero(high > low):  # equal scores: those of smaller ids come before
                        above[a + i] += np.searchsorted(order[low[i] : high[i]], place[i])
                    before[a:b] += place
                    nonzero[a:b] += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(above), pa.array(before), pa.array(nonzero)], ["pair", "above", "before", "nonzero"])

        counted = _entries(leg, held).mapInArrow(count, "pair long, above long, before long, nonzero long").groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("above", "before", "nonzero")])
        named = pa.table({"pair": np.arange(len(q)), "query_id": held.ids.take(pa.array(q)), "doc_id": asked.column("doc_id").take(pa.array(by)), "score": scored, "near": near})
        whole = pairs.sparkSession.createDataFrame(named).join(counted, "pair", "left").join(places, "doc_id")
        zero = F.when(F.col("near") == 0, F.col("place") - F.coalesce("before", F.lit(0))).when(F.col("near") < 0, F.lit(size) - F.coalesce("nonzero", F.lit(0))).otherwise(0)
        found.append(store.materialise(whole.select("query_id", "doc_id", "score", (1 + F.coalesce("above", F.lit(0)) + zero).cast("long").alias("rank")), "pair-ranks", _records(leg)))
    # A query that has no term in this leg has score 0 with every document.
    rest = pairs.join(leg.queries.select("query_id").distinct(), "query_id", "left_anti").join(places, "doc_id")
    found.append(rest.select("query_id", "doc_id", F.lit(0.0).alias("score"), (F.col("place") + 1).cast("long").alias("rank")))
    return _union(found, leg, "score double, rank long")
