"""Toxicity of texts from their nearest labelled examples by TF-IDF cosine.

The examples are a bounded sample of labelled documents (at most ``per_class`` of each label, those of
the smallest hashes of their ids). From them come the terms, words and the letter n-grams inside words that
tell the labels apart: those whose chi-squared score none of the tested terms would reach by chance, but for
odds of ``CHANCE``. They have an idf and an inverted index over the examples' unit TF-IDF
vectors, kept as postings by block and term. Examples are dealt into blocks and every term keeps its largest weight in each block. For a
text, the terms' block maxima bound the cosine of every example of a block. Its two best blocks are evaluated
first; then those whose bound reaches the k-th best cosine found, and no others: the k nearest
are exact. Texts of a batch that visit the same block are evaluated together. The nearest vote with the square of their cosine; an isotonic fit of leave-one-out votes on the
examples, weighted back to the labels' true shares, turns votes into probabilities.

Every text is scored whole, by its words alone.
"""

from __future__ import annotations

import bisect
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from .memory import returned

#: Examples of each label that are kept at most.
PER_CLASS = 3000
#: Neighbours that vote.
NEIGHBOURS = 15
#: Examples in a block of the index.
BLOCK = 64
#: Odds that any of the tested terms passes by chance, and examples that a tested term is in at least.
CHANCE, LEAST = 0.01, 3
#: Texts that are searched together.
BATCH = 128
#: Bytes of an index that is sent to the workers at most, and of blocks that a worker keeps laid out.
SENT_BYTES, LAID_BYTES = 512 << 20, 48 << 20
#: Weight of the share of toxic labels among the votes.
PRIOR_WEIGHT = 0.3

_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W+")


def word_terms(word: str) -> set[str]:
    """The word itself and its letter n-grams of 4 and 5, with marks at its ends."""
    marked = f"^{word}$"
    return {marked} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}


def terms_of(text: str | None) -> set[str]:
    """The distinct terms of a text."""
    return set().union(*map(word_terms, set(_WORD.findall((text or "").lower()))))


class Vocabulary:
    """The kept terms; all their occurrences in a text are found in one pass of an Aho-Corasick automaton."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> list[str]:
        return self.terms

    def __setstate__(self, terms: list[str]) -> None:
        self.__init__(terms)

    def counts(self, text: str | None) -> dict[int, int]:
        if not self.terms:
            return {}
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for i, t in enumerate(self.terms):
                self.automaton.add_word(t, i)
            self.automaton.make_automaton()
        # Terms hold ^ only first and $ only last, so none can reach over the end of a word.
        marked = f"^{_GAP.sub('$^', (text or '').lower())}$"
        return dict(Counter(i for _, i in self.automaton.iter(marked)))


class Index:
    """A block-max index of labelled examples."""

    def __init__(self, counts: list[dict[int, int]], toxic: list[int], doc_ids: list[int], n_terms: int, weight: tuple[float, float]):
        n = len(counts)
        df = np.zeros(n_terms)
        for c in counts:
            df[list(c)] += 1
        self.idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
        vectors = [self.vector(c) for c in counts]
        # Examples with the same strongest term stand together, so that block maxima are tight.
        order = sorted(range(n), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else n_terms, doc_ids[i]))
        self.doc_ids = np.array([doc_ids[i] for i in order], np.int64)
        self.toxic = np.array([toxic[i] for i in order], np.float64)
        self.blocks = -(-n // BLOCK)
        term = np.concatenate([vectors[i][0] for i in order]) if n else np.empty(0, np.int64)
        row = np.repeat(np.arange(n), [len(vectors[i][0]) for i in order]) if n else np.empty(0, np.int64)
        value = np.concatenate([vectors[i][1] for i in order]) if n else np.empty(0, np.float32)
        by = np.lexsort((row, term, row // BLOCK))
        #: Postings by block and term: the term, the example's place in the block, the weight.
        self.term, self.place, self.weight = term[by].astype(np.int32), (row[by] % BLOCK).astype(np.uint8), value[by]
        self.starts = np.searchsorted(row[by] // BLOCK, np.arange(self.blocks + 1))
        #: Each term's largest weight in each block.
        self.maxima = np.zeros((n_terms, self.blocks), np.float32)
        np.maximum.at(self.maxima, (self.term, row[by] // BLOCK), self.weight)
        self.laid: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.laid_bytes = 0
        self.known: dict[tuple, tuple[float, list[int]]] = {}  # results of repeated texts
        share = np.array([weight[int(t)] for t in self.toxic])
        self.prior = float((share * self.toxic).sum() / share.sum()) if n else 0.0
        self.steps: tuple[list[float], list[float]] = ([], [])
        if n:
            found = [f for a in range(0, n, BATCH) for f in self.nearest([vectors[i] for i in order[a : a + BATCH]], NEIGHBOURS, list(range(a, min(n, a + BATCH))))]
            votes = np.array([self.vote(*f) for f in found])
            self.steps = isotonic(votes, self.toxic, share)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"laid": {}, "laid_bytes": 0, "known": {}}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a block and its weights (terms x examples); those that were laid out stay, up to ``LAID_BYTES``."""
        if b in self.laid:
            return self.laid[b]
        a, e = self.starts[b], self.starts[b + 1]
        terms, at = np.unique(self.term[a:e], return_inverse=True)
        weights = np.zeros((len(terms), BLOCK), np.float32)
        weights[at, self.place[a:e]] = self.weight[a:e]
        if self.laid_bytes + weights.nbytes <= LAID_BYTES:
            self.laid[b], self.laid_bytes = (terms, weights), self.laid_bytes + weights.nbytes
        return terms, weights

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(term ids, unit weights) with sublinear term frequency; empty if no kept term occurs."""
        ids = np.fromiter(counts.keys(), np.int64, len(counts))
        w = (1.0 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.idf[ids]
        norm = np.sqrt((w * w).sum())
        return ids, (w / norm if norm > 0 else w).astype(np.float32)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the rows and cosines of the k nearest examples of positive cosine, nearest first, ties by row.

        ``skip``: a row that each leaves out.
        """
        x = np.zeros((len(vectors), len(self.maxima)), np.float32)
        for i, (ids, w) in enumerate(vectors):
            x[i, ids] = w
        bounds = x @ self.maxima
        cos = np.zeros((len(vectors), self.blocks, BLOCK), np.float32)
        wanted = np.zeros(bounds.shape, bool)
        first = np.argpartition(-bounds, 1, axis=1)[:, :2] if bounds.shape[1] > 2 else np.tile(np.arange(bounds.shape[1]), (len(x), 1))
        np.put_along_axis(wanted, first, True, axis=1)
        self._evaluate(x, wanted, cos, skip)
        some = np.take_along_axis(cos, first[:, :, None], 1).reshape(len(x), -1)
        if some.shape[1] > k:
            # No example of a block with a lower bound can be nearer than the k-th of these.
            least = np.maximum(np.partition(some, -k, axis=1)[:, -k], 0.0) - 1e-6
            self._evaluate(x, (bounds >= least[:, None]) & (bounds > 0) & ~wanted, cos, skip)
        else:
            self._evaluate(x, (bounds > 0) & ~wanted, cos, skip)
        out = []
        for own in cos.reshape(len(x), -1):
            keep = np.flatnonzero(own > 0)
            if len(keep) > 4 * k:
                # Of equal cosines all stay, for the order by row.
                keep = np.flatnonzero(own >= max(np.partition(own, -k)[-k], np.finfo(np.float32).tiny))
            keep = keep[np.lexsort((keep, -own[keep]))[:k]]
            out.append((keep, own[keep].astype(np.float64)))
        return out

    def _evaluate(self, x: np.ndarray, wanted: np.ndarray, cos: np.ndarray, skip: list[int] | None) -> None:
        """Fill in the cosines of the texts and blocks that are wanted."""
        for b in np.flatnonzero(wanted.any(0)):
            some = np.flatnonzero(wanted[:, b])
            terms, weights = self.block(int(b))
            cos[some, b] = x[np.ix_(some, terms)] @ weights
            if skip is not None:
                for i in some[[skip[i] // BLOCK == b for i in some]]:
                    cos[i, b, skip[i] % BLOCK] = 0.0

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        w = cos * cos
        return float(((w * self.toxic[rows]).sum() + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def score(self, counts: list[dict[int, int]]) -> list[tuple[float, list[int]]]:
        """(probability, the three nearest examples' ids) of texts by their counts of terms."""
        keys = [tuple(sorted(c.items())) for c in counts]
        new = dict.fromkeys(key for key in keys if key not in self.known)
        if len(self.known) + len(new) > 10_000:
            self.known.clear()
            new = dict.fromkeys(keys)
        todo = list(new)
        for a in range(0, len(todo), BATCH):
            some = todo[a : a + BATCH]
            for key, found in zip(some, self.nearest([self.vector(dict(key)) for key in some], NEIGHBOURS), strict=True):
                self.known[key] = self._fitted(*found)
        return [self.known[key] for key in keys]

    def _fitted(self, rows: np.ndarray, cos: np.ndarray) -> tuple[float, list[int]]:
        at, value = self.steps
        vote = self.vote(rows, cos)
        if not at:
            return 0.0, []
        # The fitted probability, with a trace of the vote so that the order within a step is kept.
        p = value[max(0, bisect.bisect_right(at, vote) - 1)]
        return min(1.0, max(0.0, 0.002 * vote + 0.998 * p)), [int(d) for d in self.doc_ids[rows[:3]]]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Left ends and values of the steps of the non-decreasing least-squares fit of y on x."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        if steps and steps[-1][0] == a:
            steps[-1][1] += b * c
            steps[-1][2] += c
        else:
            steps.append([a, b * c, c])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, s, c2 = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += c2
    return [float(s[0]) for s in steps], [float(s[1] / s[2]) for s in steps]


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tally: dict[str, list[int]] = {}
    rows = lambda: pd.DataFrame([(t, a, b) for t, (a, b) in tally.items()], columns=["term", "clean", "toxic"])
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            for t in terms_of(text):
                tally.setdefault(t, [0, 0])[int(label)] += 1
            if len(tally) > 50_000:  # Spark adds up the parts
                yield rows()
                tally = {}
    yield rows()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Vocabulary, Index]:
    """Vocabulary and index from the labelled documents that are not held out.

    Every term that passes the tests is kept; the bound on examples bounds them.
    """
    spark = docs.sparkSession
    own = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    )
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = []
    for label in (0, 1):
        chosen += [(r.doc_id, label) for r in own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    # At most 2 * per_class rows, so sending them to every executor is bounded.
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    sample = store.materialise(sample.repartition(16), "toxic-examples")
    found = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = found.get(0, 0), found.get(1, 0)
    tally = sample.select("text", "toxic").mapInPandas(returned(_tally), "term string, clean long, toxic long")
    a, b = F.sum("toxic"), F.sum("clean")
    summed = tally.groupBy("term").agg(a.cast("double").alias("a"), b.cast("double").alias("b")).where(F.col("a") + F.col("b") >= LEAST)
    summed = store.materialise(summed, "toxic-terms")
    total = float(max(1, n0 + n1))
    # Bonferroni: the square of the normal quantile at CHANCE over the number of tests.
    bound = NormalDist().inv_cdf(1 - CHANCE / max(1, summed.count()) / 2) ** 2
    chi = total * F.pow(F.col("a") * (n0 - F.col("b")) - F.col("b") * (n1 - F.col("a")), 2) / (max(1, n1) * max(1, n0) * (F.col("a") + F.col("b")) * F.greatest(F.lit(0.5), total - F.col("a") - F.col("b")))
    ranked = summed.withColumn("chi", chi).where(F.col("chi") > bound).orderBy(F.desc("chi"), "term").select("term")
    vocabulary = Vocabulary([r.term for r in ranked.collect()])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [vocabulary.counts(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "ids": [list(c) for c in counts], "tf": [list(c.values()) for c in counts]})

    rows = sample.mapInPandas(returned(vectors), "doc_id long, toxic int, ids array<int>, tf array<int>").orderBy("doc_id", "ids").collect()
    weight = tuple(totals.get(c, 0) / max(1, found.get(c, 0)) for c in (0, 1))
    index = Index([dict(zip(r.ids, r.tf, strict=True)) for r in rows], [r.toxic for r in rows], [r.doc_id for r in rows], len(vocabulary.terms), weight)
    return vocabulary, index


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every document.

    ``docs``: doc_id and text; ``labels``: doc_id and toxic (0, 1); more columns are ignored. Of several
    labels of a document the largest counts; null labels and null ids are left out. Null, empty and
    term-free texts get the fitted probability of a text without evidence; long texts are read whole, rows of
    one doc_id each get a score. Without any labels scores are 0, an empty table gives an empty result. ``evidence`` holds the ids of the three nearest examples.
    """
    spark = docs.sparkSession
    with store.scratch(spark):
        vocabulary, index = fit(docs, labels, **options)
        # Postings of a bounded number of examples, and a maximum for each term and block.
        data = cloudpickle.dumps((vocabulary, index))
        if len(data) > SENT_BYTES:
            raise ValueError(f"an index of {len(data)} bytes is too large to be sent: learn from fewer than {options.get('per_class', PER_CLASS)} examples of each label")
        sent = spark.sparkContext.broadcast(data)

        def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocabulary, index = pickle.loads(sent.value)
            for batch in batches:
                found = index.score([vocabulary.counts(t) for t in batch["text"]])
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": [s for s, _ in found], "evidence": [e for _, e in found]})

        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
        scored = source.mapInPandas(returned(scores), "doc_id long, held_out boolean, score double, evidence array<long>")
        scored = store.kept(scored, "toxic-scores", records=500)
        sent.destroy()  # executors and their workers keep it no longer
        return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
