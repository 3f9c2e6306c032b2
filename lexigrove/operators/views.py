"""Text views of catalogue entries: shared prefixes removed, qualifiers of a group told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_parts, short_family, strip, trim_to_word


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("long")


def prefix_by_group(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, prefix_len): of all a group's texts, which is that of the smallest and the largest; 0 for one text."""
    ends = rows.groupBy(group).agg(F.min(text).alias("low"), F.max(text).alias("high"), F.count(text).alias("n"))
    return ends.select(group, F.when(F.col("n") < 2, F.lit(0).cast("long")).otherwise(common_prefix(F.col("low"), F.col("high"))).alias("prefix_len"))


def shared_values(rows: DataFrame, group: str, values: str) -> DataFrame:
    """(group, shared): the values that every row of a group of two or more has, sorted.

    Counted instead of intersected, so that a group is never gathered in one place.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    held = rows.select(group, F.explode(F.array_distinct(values)).alias("v")).groupBy(group, "v").agg(F.count(F.lit(1)).alias("k"))
    full = held.join(sizes, group).where("k = n and n > 1").groupBy(group).agg(F.sort_array(F.collect_list("v")).alias("shared"))
    return sizes.select(group).join(full, group, "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))


def without(values: Column, shared: Column) -> Column:
    """The values that are not shared, in order and with repeats."""
    return F.filter(values, lambda v: ~F.array_contains(shared, v))


def code_levels(code: Column) -> list[Column]:
    return [F.substring(code, 1, n).alias(name) for n, name in ((2, "chapter"), (4, "heading"), (6, "subheading"))]


def catalogue(entries: DataFrame, codes: DataFrame) -> DataFrame:
    """Catalogue entries with their text views.

    ``entries``: (regulation_id, code, description, explanation, …); ``codes``: nodes by code with
    ``chain``, ``label`` and ``gloss`` (see ``tree``). Codes that the tree lacks give empty parts.
    """
    node = codes.select("code", F.col("label").alias("leaf"), F.coalesce("gloss", F.lit("")).alias("gloss"), F.transform(F.filter("chain", lambda x: (x["depth"] > 2) & (x["label"] != "")), lambda x: x["label"]).alias("path"))
    name = lambda key, out: codes.select(F.col("code").alias(key), F.col("label").alias(out))
    prefix = prefix_by_group(entries.withColumn("heading", F.substring("code", 1, 4)), "heading", "description")
    rows = entries.select("*", *code_levels(F.col("code"))).join(node, "code", "left")
    rows = rows.join(name("chapter", "chapter_label"), "chapter", "left").join(name("heading", "heading_label"), "heading", "left").join(prefix, "heading", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("leaf", "gloss", "chapter_label", "heading_label")})
    rows = rows.withColumn("path", F.coalesce("path", F.array().cast("array<string>"))).withColumn("desc", strip(F.col("description"))).withColumn("expl", strip(F.col("explanation")))
    rows = rows.withColumn("tail", trim_to_word(F.col("desc"), F.col("prefix_len").cast("int")))
    rows = rows.join(shared_values(rows, "heading", "path"), "heading")
    chain = lambda path: F.array_join(F.transform(path, lambda q: short_family(q, 150)), " › ")
    tail = F.when((F.col("tail") != "") & (F.col("tail") != F.col("desc")), F.col("tail")).otherwise("")
    own = join_parts(chain(without(F.col("path"), F.col("shared"))), F.col("leaf"), F.when(F.col("tail") != F.col("desc"), F.col("tail")).otherwise(""))
    return rows.withColumns(
        {
            "coarse_text": join_parts(F.col("chapter_label"), F.col("heading_label"), F.col("expl"), F.col("desc")),
            "fine_text": join_parts(short_family(F.col("heading_label")), chain(F.col("path")), F.col("leaf"), F.when(F.lower("gloss") != F.lower("desc"), F.col("gloss")).otherwise(""), tail),
            "disc_text": F.coalesce(*[F.nullif(c, F.lit("")) for c in (own, F.col("leaf"), F.col("tail"))], F.col("desc")),
        }
    )


#: Texts of a catalogue's entries that its statistics are of.
VIEWS = ("coarse_text", "fine_text", "disc_text")


def statistics(median: bool = True) -> list[Column]:
    """Aggregates over a ``catalogue``: entries, characters of each view, entries without a path and without a gloss.

    Without the medians they can be observed while the catalogue is written.
    """
    size = {v: F.char_length(v) for v in VIEWS}
    middle = [F.median(n).alias(f"{v}_median") for v, n in size.items()] if median else []
    most = [F.coalesce(F.max(n), F.lit(0)).cast("long").alias(f"{v}_max") for v, n in size.items()]
    return [F.count(F.lit(1)).alias("entries"), *middle, *most, F.count_if(F.size("path") == 0).alias("no_path"), F.count_if(F.col("gloss") == "").alias("no_gloss")]
