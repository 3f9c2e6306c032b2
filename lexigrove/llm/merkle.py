"""Merkle manifest of a corpus by language, and proofs that are looked up by coordinates.

A leaf is the hash of a document's fields. A language's leaves, by doc_id, are the lowest level of its tree: eight nodes
in a row become one until one is left, the subroot; the subroots in the order of their languages become the root in the same way.

The siblings that a proof needs follow from a leaf's index and its group's size alone. The leaves of one run of eight need the
same nodes above their own level, so a run explodes the coordinates (tree, level, index) once for its leaves, joins the
table of nodes, and puts what it finds in order; each leaf then concatenates its siblings and is folded to the root.

No task depends on a large language or a node that everyone asks for: places come from ranges of (language, doc_id) and sums over the
ranges, nodes of high levels stand in the table once for each block of 4096 runs that asks for them, and nothing is broadcast by us.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import store

#: Nodes that become one: 2 to this power.
BITS = 3
#: Runs that share a copy of a node, or of a subroot's siblings: 2 to this power.
BLOCK_BITS = 12
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots; those of languages are named "-" (null) or "=" and the language, so that null comes first.
TOP = ""

RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

_STEPS = "array<struct<before:string,after:string>>"
_FOLD = "aggregate({steps}, {start}, (acc, s) -> sha2(concat(s.before, acc, s.after), 256))"
_FLAT = "array_join(transform({steps}, s -> concat(s.before, s.after)), '')"


def digest(*columns: Column) -> Column:
    """Lower-case hex sha256 of fields: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def _height(count: str) -> str:
    """SQL for the levels above the lowest one of a tree of ``count`` nodes."""
    return f"size(filter(sequence(0, 20), k -> shiftleft(1L, {BITS} * k) < {count}))"


def _placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """The rows in ranges of ``order``, with their range (``part``) and a number that grows within it (``place``)."""
    # Equal rows in any number are parted by a number of their own; which is which changes nothing.
    keys = [F.col(c).asc_nulls_first() for c in order]
    spread = rows.withColumn("row", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*keys, F.col("row").asc()).sortWithinPartitions(*keys).drop("row")
    placed = store.materialise(ranged.withColumn("place", F.monotonically_increasing_id()), label)
    return placed.withColumn("part", F.shiftright("place", 33))


def _spans(placed: DataFrame, group: list[str], label: str) -> DataFrame:
    """(group, part, shift, n): what to add to a place for the index in its group, and the rows of each range."""
    counted = placed.groupBy(*group, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return store.materialise(counted.withColumn("shift", F.coalesce(before, F.lit(0)) - F.col("first")), label)


def leaves(docs: DataFrame, claim: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs of leaves and the trees.

    Runs: (tree, run, n, members), members of one run by index: (idx, doc_id, leaf, claimed). Trees: (tree, n, pos), pos
    by the order of languages. ``claimed`` is the leaf with ``claim`` as its text, null where that is the same.
    """
    source = [F.col(c) for c in FIELDS]
    own, other = digest(*source), digest(*source[:-1], F.col("text") if claim is None else claim)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        own.alias("leaf"),
        (F.lit(None).cast("string") if claim is None else F.when(other != own, other)).alias("claimed"),
    )
    placed = _placed(rows, ["tree", "doc_id", "leaf", "claimed"], "merkle-leaves")
    spans = _spans(placed, ["tree"], "merkle-spans")
    named = _placed(spans.groupBy("tree").agg(F.sum("n").alias("n")), ["tree"], "merkle-trees")
    trees = named.join(_spans(named, [], "merkle-tree-spans").select("part", "shift"), "part").select("tree", "n", (F.col("place") + F.col("shift")).alias("pos"))
    trees = store.materialise(trees, "merkle-tree-places")
    # The size of a tree comes with the range, so that no large language is the key of a join with the leaves.
    sized = spans.select("tree", "part", "shift").join(trees.select("tree", "n"), "tree")
    indexed = placed.join(sized, ["tree", "part"]).withColumn("idx", F.col("place") + F.col("shift"))
    member = F.struct("idx", "doc_id", "leaf", "claimed")
    runs = indexed.groupBy("tree", F.shiftright("idx", BITS).alias("run"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return store.materialise(runs, "merkle-runs"), trees


def nodes(lowest: DataFrame, height: int, label: str) -> DataFrame:
    """(tree, level, idx, count, digest) of every level over ``lowest`` (tree, idx, count, digest).

    ``count``: nodes of the tree's lowest level; ``height``: levels above it in the largest tree.
    """
    level = lowest.select("tree", F.lit(0).alias("level"), "idx", "count", "digest")
    found = level
    for k in range(1, height + 1):
        # A tree has a next level while more than one node remains.
        pairs = level.where(f"level < {_height('count')}").groupBy("tree", "count", F.shiftright("idx", BITS).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        made = pairs.select("tree", F.lit(k).alias("level"), F.col("up").alias("idx"), "count", F.expr("sha2(array_join(run.digest, ''), 256)").alias("digest"))
        level = store.materialise(made, f"{label}-{k}")
        found = found.unionByName(level)
    return found


def lookups(starts: DataFrame, table: DataFrame) -> DataFrame:
    """(tree, pos, steps): for each start (tree, pos, count) the siblings on its way up, level by level.

    A start explodes the coordinates it needs, each joins its node, and those of a start are put in order: what stands
    before and after its own node in every run, as two strings of digests.
    """
    levels = starts.where("count > 1").select("tree", "pos", "count", F.expr(f"explode(sequence(0, {_height('count')} - 1))").alias("level"))
    own = levels.withColumn("own", F.expr(f"shiftright(pos, {BITS} * level)"))
    base = f"shiftleft(shiftright(own, {BITS}), {BITS})"
    there = f"shiftright(count - 1, {BITS} * level)"  # the last index of the level
    wanted = own.withColumn("idx", F.expr(f"explode(sequence({base}, least({base} + {(1 << BITS) - 1}, {there})))"))
    block = f"if({BITS} * (level + 1) > {BLOCK_BITS}, shiftright({{}}, {BLOCK_BITS}), 0L)"
    # The own node comes too, so that a level without siblings is a step as well; it needs no lookup.
    asked = wanted.where("idx <> own").withColumn("block", F.expr(block.format("pos")))
    first = f"shiftleft(shiftright(idx, {BITS}), {BITS} * (level + 1))"
    last = f"least(shiftleft(shiftright(idx, {BITS}) + 1, {BITS} * (level + 1)), count) - 1"
    served = table.where(f"level < {_height('count')}").withColumn("block", F.expr(f"explode(sequence({block.format(first)}, {block.format(last)}))")).drop("count")
    met = asked.join(served, ["tree", "level", "idx", "block"]).select("tree", "pos", "count", F.struct("level", "idx", (F.col("idx") < F.col("own")).alias("left"), "digest").alias("node"))
    found = met.groupBy("tree", "pos", "count").agg(F.sort_array(F.collect_list("node")).alias("path"))
    side = "array_join(transform(filter(path, x -> x.level = l and {}x.left), x -> x.digest), '')"
    steps = f"transform(sequence(0, {_height('count')} - 1), l -> struct({side.format('')} as before, {side.format('not ')} as after))"
    return found.select("tree", "pos", F.expr(f"cast({steps} as {_STEPS})").alias("steps"))


def proofs(docs: DataFrame, claim: Column | None = None) -> DataFrame:
    """Manifest and proof of every document: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``docs``: doc_id, source, lang, n_chars, text; more columns are ignored. ``claim``: the text whose leaf is folded with
    the manifest's siblings (the document's own by default), so that ``verified`` (the folded root equals the root) tells
    whether it is unchanged.

    Null and empty fields are different leaves. Null ids come first in their language, null languages first of all. Rows of one doc_id
    are leaves of their own, by the hash; repeated rows are equal leaves with proofs of their own places. Texts are hashed whole. An
    empty table gives an empty result. A single document is its own subroot and root, with the proof of no siblings.
    """
    spark = docs.sparkSession
    with store.scratch(spark):
        runs, trees = leaves(docs, claim)
        sizes = trees.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("most")).first()
        if not sizes["trees"]:
            return store.kept(spark.createDataFrame([], RESULT), "merkle-proofs")
        levels = lambda count: max(0, -(-(count - 1).bit_length() // BITS))
        run_digest = "if(n = 1, members[0].leaf, sha2(array_join(members.leaf, ''), 256))"
        lowest = runs.select("tree", F.col("run").alias("idx"), F.expr(f"shiftright(n - 1, {BITS}) + 1").alias("count"), F.expr(run_digest).alias("digest"))
        table = nodes(lowest, levels(-(-sizes["most"] >> BITS)), "merkle-nodes")
        subroots = table.where(f"level = {_height('count')}").select("tree", F.col("digest").alias("subroot"), "count")
        named = store.materialise(trees.join(subroots, "tree").select("tree", "pos", "subroot", F.col("count").alias("runs")), "merkle-subroots")
        tops = named.select(F.lit(TOP).alias("tree"), F.col("pos").alias("idx"), F.lit(sizes["trees"]).alias("count"), F.col("subroot").alias("digest"))
        over = nodes(tops, levels(sizes["trees"]), "merkle-top")
        root = over.where(f"level = {_height('count')}").first()["digest"]
        ways = lookups(tops.select("tree", F.col("idx").alias("pos"), "count"), over).select("pos", F.col("steps").alias("top_steps"))
        served = named.join(ways, "pos", "left").withColumn("block", F.expr(f"explode(sequence(0L, shiftright(runs - 1, {BLOCK_BITS})))")).select("tree", "block", "subroot", "top_steps")
        paths = lookups(lowest.select("tree", F.col("idx").alias("pos"), "count"), table).select("tree", F.col("pos").alias("run"), "steps")
        joined = runs.join(paths, ["tree", "run"], "left").withColumn("block", F.shiftright("run", BLOCK_BITS)).join(served, ["tree", "block"])
        none = F.expr(f"cast(array() as {_STEPS})")
        way = joined.select("n", "members", "subroot", F.concat(F.coalesce("steps", none), F.coalesce("top_steps", none)).alias("steps"))
        each = way.withColumn("flat", F.expr(_FLAT.format(steps="steps"))).select("n", "members", "subroot", "steps", "flat", F.posexplode("members").alias("at", "m"))
        near = each.withColumn("near", F.expr("struct(array_join(slice(members.leaf, 1, at), '') as before, array_join(slice(members.leaf, at + 2, 8), '') as after)"))
        start = "coalesce(m.claimed, m.leaf)"
        begun = near.withColumn("begun", F.expr(f"if(n = 1, {start}, sha2(concat(near.before, {start}, near.after), 256))"))
        result = begun.select(
            F.col("m.doc_id").alias("doc_id"),
            F.col("m.leaf").alias("leaf"),
            "subroot",
            F.lit(root).alias("root"),
            F.expr("sha2(concat(near.before, near.after, flat), 256)").alias("proof_sha256"),
            F.expr(_FOLD.format(steps="steps", start="begun")).alias("folded_root"),
        )
        return store.kept(result.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-proofs")


def lowered(doc_id: Column, text: Column) -> Column:
    """A text to be claimed: lower-cased in A-Z where 3 divides the crc32 of the doc_id in decimal. Null ids and texts stay."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, F.translate(text, upper, upper.lower())).otherwise(text)
