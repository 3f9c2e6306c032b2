"""Benchmark passages in documents, by SimHash over item-sized windows; DataFrame operations only.

Texts are words with A-Z in lower case. A window of an item's number of words slides over a document
(the whole document where it is shorter), and a window matches an item when the weighted Jaccard
similarity of their five-word shingles, counted with repeats, is 0.75 or more.

Which windows get a fingerprint: one that matches an item has shingles in common with it, and moving its start
to the first of them loses none. So windows of every size that an item has are taken at the places
where some item of that size has a shingle, and where such a window would end beyond the document, at its end.
This leaves out no match, and says nothing yet of which items a window matches. Equal windows of all documents are one.

Candidates: fingerprints are 64 bits, the majority of the shingles' hash bits. A multi-index over 8 blocks of 8 bits
finds every item of the window's size within ``RADIUS`` bits: of at most 23 differing bits, some block has at most two,
and the index holds each item block with all its neighbours at distance 0, 1 and 2. Similarity 0.75
of equal sizes is a cosine of 6/7, for which 11 differing bits are expected; 23 are 4 standard
deviations above. Candidates are verified by exact weighted similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from .words import ascii_lower, word_array

WIDTH = 5
PERCENT = 75
RADIUS = 23
BLOCKS = 8
#: Most entries of a table that are broadcast, of at most some tens of bytes each; larger tables are shuffled.
SENT = 500_000


def _word_hashes(text: Column) -> Column:
    return F.transform(word_array(ascii_lower(text)), lambda w: F.xxhash64(w))


def _shingles(words: Column, width: Column | int) -> Column:
    """Hashes of the shingles of ``width`` words at each position; no fewer than one position."""
    n = F.size(words) - width
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, width)))


def _positions(words: Column, width: int) -> Column:
    """The same for documents and a fixed width: (width, position, hash), none if there are too few words."""
    n = F.size(words) - width
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    entry = lambda i: F.struct(F.lit(width).alias("k"), i.alias("pos"), at(i).alias("shingle"))
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), entry)).otherwise(F.array().cast("array<struct<k:int,pos:int,shingle:bigint>>"))


def simhash(shingles: Column) -> Column:
    """Bit b is set if more than half of the shingles (with repeats) have bit b set."""
    votes = lambda b: F.aggregate(shingles, F.lit(0), lambda acc, x: acc + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1)).cast("int"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(votes(b) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def _blocks(fingerprint: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
        lambda b: F.struct(b.alias("block"), F.call_function("shiftrightunsigned", fingerprint, b * (64 // BLOCKS)).bitwiseAND(F.lit(255)).cast("int").alias("value")),
    )


def _neighbours() -> Column:
    """All 8-bit masks of at most two bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(255)), lambda m: F.bit_count(m) <= RADIUS // BLOCKS)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger counts of each shingle."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)
    return both / (F.size(a) + F.size(b) - both)


def _bounded(df: DataFrame, entries: int | None = None) -> DataFrame:
    """A written table, marked for broadcast if its rows, or the ``entries`` of its arrays, are few."""
    return F.broadcast(df) if (df.count() if entries is None else entries) <= SENT else df


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, start, similarity): each document's best window for each item that it holds.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; more columns are ignored. ``start`` is the
    window's first word, from 0; of equally similar windows that start at a shingle of the item the first counts. Null and blank texts on
    either side match nothing; texts of any length are searched whole. An item of fewer than five words is one shingle and matches wherever
    its words stand in a row. Rows that share a doc_id are searched apart and reported together, repeated rows and null ids too; rows
    of one item_id are items of their own, reported together. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    with store.scratch(spark):
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0)
        items = items.withColumn("w", F.size("words")).withColumn("k", F.least(F.lit(WIDTH), F.col("w"))).withColumn("own", _shingles(F.col("words"), F.col("k")))
        items = store.materialise(items.select("item_id", "w", "k", "own", F.xxhash64("words").alias("item"), simhash(F.col("own")).alias("print")), "leak-items")
        widths = [r.k for r in items.select("k").distinct().orderBy("k").collect()]  # of 1 to 5
        if not widths:
            return docs.select(F.col("doc_id").cast("long").alias("doc_id")).limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("start", "int"), ("similarity", "double"))])
        anchors = store.materialise(items.select("w", "k", F.explode("own").alias("shingle")).distinct(), "leak-anchors")

        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
        words = source.select("row", _word_hashes(F.col("text")).alias("words"))
        spread = words.select("row", F.size("words").alias("n"), F.explode(F.concat(*[_positions(F.col("words"), k) for k in widths])).alias("p"))
        hits = spread.select("row", "n", "p.*").join(_bounded(anchors), ["k", "shingle"])
        place = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n") - F.col("w")))
        starts = store.materialise(hits.groupBy("row").agg(F.collect_set(F.struct(place.alias("start"), "w", "k")).alias("starts")), "leak-starts")

        wanted = store.materialise(starts.select("row"), "leak-rows")
        found = source.join(_bounded(wanted), "row", "left_semi").dropDuplicates(["row"]).join(starts, "row").select("doc_id", "row", _word_hashes(F.col("text")).alias("words"), "starts")
        cut = F.transform("starts", lambda s: F.struct(s["start"].alias("start"), s["w"].alias("w"), _shingles(F.slice(F.col("words"), s["start"] + 1, s["w"]), s["k"]).alias("own")))
        windows = found.select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.*").withColumn("window", F.xxhash64("w", "own"))
        windows = store.materialise(windows, "leak-windows")
        distinct = store.materialise(windows.groupBy("window").agg(F.first("w").alias("w"), F.first("own").alias("own")).withColumn("print", simhash(F.col("own"))), "leak-prints")

        keys = items.select("item", "w", "print", F.explode(_blocks(F.col("print"))).alias("b"))
        keys = keys.select("item", "w", F.col("print").alias("item_print"), "b.block", F.explode(F.transform(_neighbours(), lambda m: F.col("b.value").bitwiseXOR(m))).alias("value")).distinct()
        keys = store.materialise(keys, "leak-index")
        probes = distinct.select("window", "w", "print", F.explode(_blocks(F.col("print"))).alias("b")).select("window", "w", "print", "b.*")
        near = probes.join(_bounded(keys), ["w", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        near = near.select("window", "item").distinct().join(distinct.select("window", "own"), "window")
        shown = items.groupBy("item").agg(F.first("own").alias("item_own"), F.collect_set("item_id").alias("item_ids"))
        shown = store.materialise(shown, "leak-shown")
        entries = shown.agg(F.sum(F.size("item_own") + F.size("item_ids"))).first()[0]
        alike = near.join(_bounded(shown, entries), "item").withColumn("similarity", weighted_similarity(F.col("own"), F.col("item_own"))).where(F.col("similarity") >= percent / 100)
        alike = store.materialise(alike.select("window", "similarity", F.explode("item_ids").alias("item_id")), "leak-alike")
        met = windows.select("doc_id", "start", "window").join(_bounded(alike), "window")
        best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
        return store.kept(best.select("doc_id", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity")), "leak-found")
