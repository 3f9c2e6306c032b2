"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles, hashed once; its sketch is the smallest
hashes: k of them make lists, and more estimate similarities. Documents with the same set are collapsed
into a class first. A class is named by a key of 24 bytes, its smallest doc_id and the 128-bit hash of its
set, so that keys order like ids and rows that share an id but not a text are told apart.

Candidates. Two classes of Jaccard similarity 0.75 or more have at least 0.75 of the values of their
union's sketch in common, so that their sketches share c values or more: certain for sets of up to
40 shingles, where c = 0.75 n, and beyond that up to a binomial tail (64 draws of 0.75 below 28) of
about 1e-8. Two sketches that share c values share one of their |sketch| - c + 1 rarest values,
in whatever order rarity puts them. Inverted lists are therefore kept for those values only, rarest
first by the number of classes that retain them, and values retained by one class need no list. A
passage that thousands of documents share never makes a list unless it fills 0.4 of a sketch.

Every list has a centre, its most central member (the one whose shared values are the most and the
commonest, which is the original in a family of copies). Where few members are outside the centre's component, they are paired
with the whole list. A longer list is compared with its centre only: its members join the centre's family.
A pair (d, m) of members that the centre c leaves in different components can only be a link if it has
a shingle in common outside c, or if both |d & c| and |m & c| reach 3/7 (|d| + |m|). For the first kind,
inverted lists of the members' shingles outside c take the place of the list; for the second, lists of the whole sets of the
members that meet the centre in enough shingles for a link of their size (excerpts of it). Both are again
lists of the rarest values only, have centres of their own, and go through the next round.
So no list is cut off, no link is lost, and a family of thousands of copies costs a few passes over it.

Pairs of short lists of retained values are filtered by the similarity estimated from the union of the
sketches (5 standard deviations below the threshold). All pairs, those with centres too, are confirmed on
full sets, which are computed from the texts once a document and round.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from .components import roots
from .memory import returned
from .shingles import shingle_set

#: Retained values of a sketch that make lists.
K = 64
#: Retained values that estimate similarities.
ESTIMATED = 160
#: Values that sketches of similar sets share at least, for large sets.
COMMON = 28
#: Similarity of a link: PERCENT / 100.
PERCENT = 75
#: Most members outside the centre's component that are paired with their whole list at once; GROWTH times as many each round.
SHORT, GROWTH = 32, 8
#: Most keys that are broadcast (24 bytes each at most); beyond it they are joined by shuffle.
SENT_KEYS = 500_000

_SKETCHED = "doc_id long, n long, key binary, sketch array<long>"


def _key(doc_id: int, values: np.ndarray) -> bytes:
    """A key of a document's set: keys compare like ids, and then by the set."""
    return struct.pack(">Q", doc_id + (1 << 63)) + xxhash.xxh3_128_digest(values.tobytes())


def key_id(key: Column) -> Column:
    """The doc_id of a key."""
    return (F.conv(F.hex(F.substring(key, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def _sketcher(k: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            sets = [shingle_set(t) for t in batch["text"]]
            keys = [_key(int(d), s) if len(s) and d is not pd.NA else None for d, s in zip(ids, sets, strict=True)]
            yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], "key": keys, "sketch": [s[: max(k, ESTIMATED)] if key else None for s, key in zip(sets, keys, strict=True)]})

    return sketch


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame({"node": [_key(int(d), s) for d, s in zip(batch["doc_id"], sets, strict=True)], "values": sets})


def _bounded(df: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= SENT_KEYS else df


def _lists(entries: DataFrame, within: bool) -> DataFrame:
    """(family, value, node, n, reach, centre, probe, held) for the rare values of each member of a family.

    ``entries``: (family, value, node, n, reach, least, first), where similar members are no larger than either's ``reach`` and
    share ``least`` values or more: then they share one of all but the ``least - 1`` most common values of either. Values that
    only one member holds are the rarest and need no list. ``first`` is what members no larger share with
    it at least; the values that this leaves are marked ``probe``. Of every similar pair the smaller member
    has a common value as a probe, and the larger one has it in its list. ``within`` a family, where
    members share many values, ``held`` has all of a member's lists in order, so that a pair is made in the
    first list that it shares; there are too many rows for that at the top.
    """
    held = entries.groupBy("family", "value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = (
        entries.join(held, ["family", "value"])
        .groupBy("family", "node")
        .agg(F.first("n").alias("n"), F.first("reach").alias("reach"), F.first("least").alias("least"), F.first("first").alias("first"), F.sum("df").alias("total"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    )
    rare = F.slice("values", 1, F.greatest(F.least(F.size("values"), F.size("values") - F.col("least") + 1), F.lit(0)))
    held_lists = F.transform(rare, lambda v: v["value"]) if within else F.lit(None).cast("array<long>")
    # Central is whose shared values are the most and the commonest.
    rows = shared.select("family", "node", "n", "reach", F.col("total").alias("centre"), (F.size("values") - F.col("first")).alias("last"), held_lists.alias("held"), F.posexplode(rare).alias("pos", "v"))
    return rows.select("family", F.col("v.value").alias("value"), "node", "n", "reach", "centre", (F.col("pos") <= F.col("last")).alias("probe"), "held")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether set sizes allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """``pairs`` (a, b, star, …) with ``common``, ``linked`` and, of stars, b's shingles ``outside`` a and all of ``b_set``.

    Each involved text is read and made a set once; pairs are joined with sets.
    """
    involved = store.materialise(pairs.select(key_id(F.col("a")).alias("id")).union(pairs.select(key_id(F.col("b")))).distinct(), "dup-involved")
    texts = docs.join(_bounded(involved), docs["doc_id"] == involved["id"], "left_semi").where("text is not null")
    sets = store.materialise(texts.mapInPandas(returned(_sets), "node binary, values array<long>"), "dup-sets", records=500)
    if repeated:  # rows of one doc_id and text
        sets = sets.dropDuplicates(["node"])
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("values").alias("b_set")), "b").join(sets.select(F.col("node").alias("a"), F.col("values").alias("a_set")), "a")
    n = F.size(F.array_intersect("a_set", "b_set"))
    counted = joined.withColumn("common", n).withColumn("linked", 100 * F.col("common") >= percent * (F.size("a_set") + F.size("b_set") - F.col("common")))
    outside, whole = F.when(F.col("star"), F.array_except("b_set", "a_set")), F.when(F.col("star"), F.col("b_set"))
    return store.materialise(counted.select(*pairs.columns, "common", "linked", outside.alias("outside"), whole.alias("b_set")), "dup-verified")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow the similarity."""
    left = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    # Up to the union's k-th value both sketches are complete.
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, ESTIMATED)
    estimate = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b"))) / F.size(union)
    t = percent / 100
    floor = F.when(F.size(union) < ESTIMATED, t).otherwise(t - 5 * (t * (1 - t) / ESTIMATED) ** 0.5)
    return pairs.join(left, "a").join(right, "b").where(estimate >= floor - 1e-9).select(*pairs.columns)


def _pairs(member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of members of a list of which one is outside the centre's component, names apart."""
    row = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "reach", "name", "probe", "held")]
    met = member.where("name <> main").select("family", "value", *row("a")).join(member.select("family", "value", *row("b")), ["family", "value"])
    met = met.where("name_a <> name_b and ((probe_a and n_a <= n_b) or (probe_b and n_b <= n_a))").where(_alike("n_a", "n_b", percent)).where("n_a <= reach_b and n_b <= reach_a")
    met = met.where(F.coalesce(F.get(F.array_intersect("held_a", "held_b"), F.lit(0)) == F.col("value"), F.lit(True)))
    turned = F.col("node_a") > F.col("node_b")
    side = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    return met.select(side("node_a", "node_b", "a"), side("node_b", "node_a", "b"), side("name_a", "name_b", "name_a"), side("name_b", "name_a", "name_b")).distinct()


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the label of their node's component as ``name``."""
    if labels is None:
        return rows.withColumn("name", F.col("node"))
    known = labels.select(F.col("node").alias("at"), F.col("label").alias("known"))
    return rows.join(known, rows["node"] == known["at"], "left").withColumn("name", F.coalesce("known", "node")).drop("at", "known")


def _relabelled(labels: DataFrame | None, moved: DataFrame) -> DataFrame:
    """Labels (node, label) after the names of ``moved`` (node, root) have been joined."""
    fresh = moved.select("node", F.col("root").alias("label"))
    if labels is None:
        return fresh
    step = moved.select(F.col("node").alias("label"), "root")
    old = labels.join(step, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return store.materialise(old.unionByName(fresh).distinct(), "dup-labels")


def _renamed(rows: DataFrame, moved: DataFrame, name: str) -> DataFrame:
    step = moved.select(F.col("node").alias(name), "root")
    return rows.join(step, name, "left").withColumn(name, F.coalesce("root", name)).drop("root")


def _own(key: str) -> Column:
    """The part of a key that is the hash of the set."""
    return F.substring(key, 9, 16)


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the ``node`` of their class; null without a key."""
    return rows.withColumn("own", _own("key")).join(classes.select("node", _own("node").alias("own")), "own", "left")


def classes_and_links(docs: DataFrame, k: int = K, common: int = COMMON, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, n, key), classes (node, n, sketch), and labels (node, label) of the linked nodes."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = store.materialise(source.mapInPandas(returned(_sketcher(k)), _SKETCHED), "dup-sketches", records=500)
    keyed = rows.where("key is not null").withColumn("own", _own("key"))
    classes = keyed.groupBy("own").agg(F.min_by(F.struct("key", "n", "sketch"), "key").alias("c")).select(F.col("c.key").alias("node"), "c.n", "c.sketch")
    classes = store.materialise(classes, "dup-nodes")
    # Sets that share a doc_id belong together whatever they hold.
    shared = store.materialise(keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "dup-shared")
    labels, repeated = None, not shared.isEmpty()
    if repeated:
        several = _classed(keyed.join(shared, "doc_id"), classes)
        moved = roots(several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")))
        labels = labels if moved is None else _relabelled(None, moved)
    # A family is what one centre has in common with others; the lists of retained values have none yet.
    at_once, tried = SHORT, None
    least = F.least(F.lit(common), F.ceil(F.col("n") * percent / 100)).cast("int")
    none, far = F.lit(b"").alias("family"), F.ceil(F.col("n") * 100 / percent)
    entries = classes.select(none, F.explode(F.slice("sketch", 1, k)).alias("value"), "node", "n", far.alias("reach"), least.alias("least"), least.alias("first"))
    while True:
        lists = store.materialise(_named(_lists(entries, tried is not None), labels), "dup-lists")
        # Counted by the names in a list before they meet, so that a common value's members are never in one place.
        best = F.struct((-F.col("centre")).alias("centre"), "node")
        if labels is None:  # every name is there once
            by_name = lists.select("family", "value", "name", F.lit(1).alias("times"), F.col("probe").alias("probed"), best.alias("best"))
        else:
            by_name = lists.groupBy("family", "value", "name").agg(F.count(F.lit(1)).alias("times"), F.max("probe").alias("probed"), F.min(best).alias("best"))
        sizes = by_name.groupBy("family", "value").agg(F.count(F.lit(1)).alias("names"), F.sum("times").alias("size"), F.max("probed").alias("probed"), F.min(F.struct("best", "name", "times")).alias("most"))
        sizes = sizes.where("names > 1 and probed").select("family", "value", F.col("most.best.node").alias("middle"), F.col("most.name").alias("main"), (F.col("size") - F.col("most.times")).alias("out"))
        member = store.materialise(lists.join(sizes, ["family", "value"]), "dup-members")
        if member.isEmpty():
            return rows, classes, labels
        short = _pairs(member.where(F.col("out") <= at_once), percent)
        if tried is not None:
            short = short.join(tried, ["a", "b"], "left_anti")
        short = store.materialise(short, "dup-short")
        # In a family sketches seldom tell what whole sets would not, and cost as much.
        likely = _likely(short, classes, percent) if tried is None else short
        tried = short.select("a", "b") if tried is None else tried.unionByName(short.select("a", "b"))
        star = member.where((F.col("out") > at_once) & (F.col("node") != F.col("middle")))
        # What a pair needed in the list's family, it needs in the next; of several lists the loosest bound counts.
        star = star.groupBy(F.col("middle").alias("a"), F.col("node").alias("b")).agg(F.first("main").alias("name_a"), F.first("name").alias("name_b"), F.first("n").alias("n"), F.max("reach").alias("reach"))
        at_once *= GROWTH
        pairs = likely.select("*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"), F.lit(False).alias("star")).unionByName(star.withColumn("star", F.lit(True)))
        found = _verified(store.materialise(pairs, "dup-pairs"), source, percent, repeated)
        moved = roots(found.where("linked").select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
        placed = found.where("star")
        if moved is not None:
            labels = _relabelled(labels, moved)
            placed = _renamed(_renamed(placed, moved, "name_a"), moved, "name_b")
        # Families that the centre has not brought into one component.
        placed = placed.withColumn("away", F.col("name_a") != F.col("name_b"))
        # Second kind: both meet the centre in enough shingles for a link of their sizes.
        meets = F.least("reach", F.floor(F.col("common") * (100 + percent) / percent + 1e-9) - F.col("n"))
        placed = store.materialise(placed.withColumn("meets", meets).withColumn("inside", F.col("meets") * 100 >= F.col("n") * percent), "dup-placed")
        lost = F.col("away") & F.col("inside")
        apart = placed.groupBy("a").agg(F.max("away").alias("any"), F.max(F.when(lost, F.col("meets"))).alias("largest"), F.min(F.when(lost, F.col("n"))).alias("smallest")).where("any")
        apart = store.materialise(apart, "dup-apart")
        if apart.isEmpty():
            return rows, classes, labels
        placed = placed.join(_bounded(apart), "a")
        # First kind: the shingles outside the centre, of which a link needs 3/7 (|d| + |m|) - |d & c|.
        need, most = F.ceil(F.col("n") * percent / 100), F.ceil(F.col("n") * 2 * percent / (100 + percent))
        first = placed.select(F.col("a").alias("family"), F.explode("outside").alias("value"), F.col("b").alias("node"), "n", "reach", (need - F.col("common")).cast("int").alias("least"), (most - F.col("common")).cast("int").alias("first"))
        second = placed.where("inside and n <= largest and meets >= smallest").select(F.concat("a", F.lit(b"+")).alias("family"), F.explode("b_set").alias("value"), F.col("b").alias("node"), "n", F.col("meets").alias("reach"), need.cast("int").alias("least"), most.cast("int").alias("first"))
        entries = first.unionByName(second)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; more are ignored).

    Texts without words and null texts have no shingles and link with nothing; texts of any length are
    taken whole. Rows that share a doc_id count as one document, which links by every set that it has, and
    each get a row. A null doc_id links with nothing, has a null component and is not kept. Links do not depend
    on the order of rows. An empty table gives an empty result.
    """
    with store.scratch(docs.sparkSession):
        rows, classes, labels = classes_and_links(docs, **options)
        rows = _classed(rows.select("doc_id", "n", "key"), classes)
        found = _named(rows, labels) if labels is not None else rows.withColumn("name", F.col("node"))
        # A null name is a row without words or id.
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce(key_id(F.col("name")), F.col("doc_id")))
        found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        return store.kept(found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "dup-found")
