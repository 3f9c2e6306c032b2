"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same copy rate: its source's target over its source's size. The
whole part of the rate is taken for certain; the fractional part is rounded by the pivotal method.
Two documents with fractional copy probabilities meet, and mass (words, that is probability times
size) moves from one to the other, in a random direction with the odds that keep both expectations,
until one probability is 0 or 1. The other stays fractional and meets the next. Words are conserved
at each meeting, so a source misses its target by less than one document.

The meetings form a reduction tree. Documents are dealt into small random groups within their
source; a fold over each group decides all but one of its members, and only the undecided go to the
next level. A source that holds a third of all rows is just more groups. Rows of equal doc_id, source
and text are one entry with a count from the start: among them mass moves until all but one are integral,
which takes no draw, so no number of equal rows makes a large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType
from pyspark.sql.window import Window

from .. import store
from .words import word_count

#: Source weights, repeated over the sources in code point order (null last).
WEIGHTS = (3.0, 1.0, 2.0)
#: Words to take, as a share of all words.
SHARE = 1.5
#: A source gives at most so many times its size.
MOST = 2.0
#: Members of a group of the reduction tree, on average.
FAN_IN = 64
SEED = 20

#: Equal rows or copies that one task writes for an entry at a time.
CHUNK = 1024

_ROW = "struct<doc_id:bigint,twin:bigint,size:bigint,n:bigint,whole:bigint,more:bigint,source_size:bigint,target:double,p:double>"
_OUT = f"array<{_ROW}>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _name(source: Column) -> Column:
    """A key that tells the null source from any other."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Word targets by source. ``sizes``: one row (source, source_size) for each source, null included.

    Targets in proportion to the weights, each stopped at ``most`` times its source's size, the
    excess shared out again until no target is above. That fixed point is min(most * size, level *
    weight) with one common level; sources reach their stop in the order of most * size / weight, so
    one ordered pass finds the level. The table has a row a source, which one task can order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    stop = F.lit(float(most)) * F.col("source_size")
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "place")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_stop.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("stop", stop)
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("stop"))
    )
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("common", level).select(
        "source", "source_size", F.least(F.col("stop"), F.coalesce(F.col("common") * F.col("weight"), F.col("stop"))).alias("target")
    )


def _random(salt: str, depth: int, row: Column) -> Column:
    """A uniform number in [0, 1) fixed by the row and the meeting's depth."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(salt), F.lit(depth), row["doc_id"], row["twin"]), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _meet(acc: Column, draw: Column, b: Column) -> Column:
    """One meeting: the carried member ``a`` against ``b``; one of them comes out integral.

    Mass moves to ``b`` as far as it fits or away from it as far as it fits, with the odds that
    leave the expected masses as they were.
    """
    a = acc["carry"]

    def bounds(s: Column) -> Column:
        total = s["a"] + s["b"]
        return F.struct(total.alias("total"), F.least(total, b["size"].cast("double")).alias("high"), (total - F.least(total, a["size"].cast("double"))).alias("low"), s["b"].alias("b"))

    def moved(s: Column) -> Column:
        up = draw * (s["high"] - s["low"]) < s["b"] - s["low"]
        new_b = F.when(up, s["high"]).otherwise(s["low"])
        first = F.when(up, s["high"] == s["total"]).otherwise(s["low"] > 0.0)
        return F.struct(new_b.alias("b"), (s["total"] - new_b).alias("a"), first.alias("first"))

    def rounded(mass: Column, size: Column) -> Column:
        p = mass / size
        return F.when(p < 1e-12, 0.0).when(p > 1 - 1e-12, 1.0).otherwise(p)

    def ended(s: Column) -> Column:
        new_a = a.withField("p", rounded(s["a"], a["size"]))
        new_b = b.withField("p", rounded(s["b"], b["size"]))
        return F.struct(
            F.when(s["first"], new_b).otherwise(new_a).cast(_ROW).alias("carry"),
            F.concat(acc["out"], F.array(F.when(s["first"], new_a.withField("p", F.round(new_a["p"]))).otherwise(new_b.withField("p", F.round(new_b["p"]))))).cast(_OUT).alias("out"),
        )

    masses = F.struct((a["p"] * a["size"]).alias("a"), (b["p"] * b["size"]).alias("b"))
    return _let(masses, lambda m: _let(bounds(m), lambda s: _let(moved(s), ended)))


def _fold(level: DataFrame, depth: int) -> DataFrame:
    """Fold each group of (name, deal); of its rows at most one still has a fractional p."""
    entry = F.struct(_random("order", depth, F.col("row")).alias("u"), _random("draw", depth, F.col("row")).alias("draw"), F.col("row"))
    grouped = level.groupBy("name", "deal").agg(F.sort_array(F.collect_list(entry)).alias("members"))
    start = F.struct(F.col("members")[0]["row"].cast(_ROW).alias("carry"), F.array().cast(_OUT).alias("out"))
    rest = F.slice(F.col("members"), 2, F.greatest(F.size("members") - 1, F.lit(0)))
    folded = F.aggregate(rest, start, lambda acc, x: _meet(acc, x["draw"], x["row"]), lambda acc: F.concat(acc["out"], F.array(acc["carry"])))
    return grouped.select("name", F.explode(folded).alias("row"))


def _twin(doc_id: Column, source: Column, text: Column) -> Column:
    """A hash by which rows of one doc_id are told apart."""
    return F.xxhash64(doc_id.cast("long"), source.cast("string"), text.cast("string"))


def entries(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, twin, size, n, whole, extra, source_size, target): the mix of ``n`` equal rows.

    Each of them is taken ``whole`` times, and ``extra`` of them once more.
    """
    rows = store.materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _twin(docs["doc_id"], docs["source"], docs["text"]).alias("twin"), word_count(docs["text"]).alias("size"))
        .groupBy("doc_id", "source", "twin", "size")
        .agg(F.count(F.lit(1)).alias("n")),
        "mix-sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes, share, most, weights).select(_name(F.col("source")).alias("name"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    snapped = lambda x: F.when(F.abs(x - F.round(x)) < 1e-12 * F.greatest(F.lit(1.0), x), F.round(x)).otherwise(x)
    rated = (
        rows.withColumn("name", _name(F.col("source")))
        .join(goal, "name")
        .withColumn("rate", snapped(rate))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("left", F.when(F.col("size") > 0, snapped((F.col("rate") - F.col("whole")) * F.col("n"))).otherwise(0.0))
        .withColumn("more", F.floor("left").cast("long"))
        .withColumn("p", F.col("left") - F.col("more"))
        .select("name", F.struct("doc_id", "twin", "size", "n", "whole", "more", "source_size", "target", "p").cast(_ROW).alias("row"))
    )
    level = store.materialise(rated, "mix-level")
    parts, depth = [], 0
    while True:
        fractional = (F.col("row")["p"] > 0.0) & (F.col("row")["p"] < 1.0)
        parts.append(level.where(~fractional).select("row"))
        left = level.where(fractional)
        counts = left.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        deals = F.greatest(F.lit(1), F.floor(F.col("n") / fan_in)).cast("long")
        spot = F.xxhash64(F.lit(SEED), F.lit("deal"), F.lit(depth), F.col("row")["doc_id"], F.col("row")["twin"])
        dealt = left.join(counts, "name").select("name", "row", F.pmod(spot, deals).alias("deal"))
        level = store.materialise(_fold(dealt, depth), "mix-level")
        depth += 1
    last = F.when(_random("last", 0, F.col("row")) < F.col("row")["p"], 1.0).otherwise(0.0)
    parts.append(left.select(F.col("row").withField("p", last).alias("row")))
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part)
    return decided.select("row.doc_id", "row.twin", "row.size", "row.n", "row.whole", (F.col("row.more") + F.col("row.p").cast("long")).alias("extra"), "row.source_size", "row.target")


def _chunks(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK).cast("long"))


def _of_chunk(n: Column) -> Column:
    """The numbers from 0 below ``n`` that belong to the chunk of the row."""
    first = F.col("chunk") * CHUNK
    return F.sequence(first, F.least(first + CHUNK, n) - 1)


def copies(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, fan_in: int = FAN_IN) -> DataFrame:
    """The mix: (doc_id, twin, size, source_size, target, copies, taken) for each row of ``docs``.

    ``docs`` needs doc_id, source and text; more columns are ignored. ``twin`` is a hash of the three,
    so that rows of one doc_id can be told apart; rows equal in them stay rows of their own, of which as many are
    taken once more as belongs to them together. Null or blank texts have size 0 and are not taken; texts of any length
    are counted whole. A null source is a source. An empty table gives an empty result.
    """
    with store.scratch(docs.sparkSession):
        found = store.kept(entries(docs, share, most, weights, fan_in), "mix-entries")
    single = found.where("n = 1").withColumn("k", F.lit(0).cast("long"))
    # A chunk is a row of its own before it is dealt out, so that many equal rows are not written by one task.
    several = found.where("n > 1").withColumn("chunk", F.explode(_chunks(F.col("n")))).repartition("doc_id", "twin", "chunk")
    each = single.unionByName(several.withColumn("k", F.explode(_of_chunk(F.col("n")))).drop("chunk"))
    taken = F.col("whole") + F.when(F.col("k") < F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "twin", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in the columns of ``docs``, whatever their names and types.

    Of rows that agree in doc_id, source and text but not in other columns one stands for all. Null, blank
    and other odd values as in ``copies``.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text")}
    key = F.coalesce(at["doc_id"].cast("long"), F.lit(0).cast("long"))
    plain = docs.toDF(*names)
    kept = plain.withColumn("twin", _twin(at["doc_id"], at["source"], at["text"])).withColumn("key", key)
    order = F.xxhash64(*[c for c, f in zip(names, docs.schema.fields, strict=True) if not _holds_map(f.dataType)])
    with store.scratch(docs.sparkSession):
        total = F.col("n") * F.col("whole") + F.col("extra")
        chosen = entries(docs, **options).select("twin", F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), "n", total.alias("copies"))
        chosen = store.kept(chosen.where("copies > 0"), "mix-chosen")

    def rows(some: DataFrame) -> DataFrame:
        met = kept.join(some, ["twin", "key"])
        one = F.min_by(F.struct(*names), F.when(F.col("n") > 1, order).otherwise(0))
        return met.groupBy("twin", "key").agg(one.alias("row"), F.first("copies").alias("copies"))

    few = rows(chosen.where(F.col("copies") <= CHUNK)).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k"))
    if chosen.where(F.col("copies") > CHUNK).isEmpty():
        return few.select("row.*").toDF(*docs.columns)
    many = rows(chosen.where(F.col("copies") > CHUNK)).withColumn("chunk", F.explode(_chunks(F.col("copies")))).repartition("twin", "key", "chunk")
    out = few.unionByName(many.select("row", F.explode(_of_chunk(F.col("copies"))).alias("k")))
    return out.select("row.*").toDF(*docs.columns)


def _holds_map(kind: DataType) -> bool:
    """Whether values of a type cannot be hashed."""
    if isinstance(kind, ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (MapType, VariantType))
