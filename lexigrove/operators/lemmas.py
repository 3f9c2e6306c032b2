"""Lemmas of forms that a dictionary lacks, by rules over word endings that are learned from the dictionary.

A pair (token, lemma) shows a paradigm: so many letters go at the token's end and others come. Every ending of the token that holds
the letters that go speaks for the paradigm, and each ending keeps the one that most of its tokens have. The endings are the
nodes of a trie over reversed words, in a table: a word follows the rule of its longest ending there. An ending whose rule is that of
the ending one letter shorter adds nothing and is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions.text import raw_tokens
from .views import common_prefix

#: Letters of the longest ending, letters that must stay of a word, and tokens that an ending needs.
LONGEST, STEM, LEAST = 6, 2, 2
CYRILLIC = "[а-яё]"


def rules(lemmas: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(ending, cut, add, n): a word with this ending loses ``cut`` letters and gets ``add``, as ``n`` of the dictionary's tokens do.

    ``lemmas``: (token, lemma); rows without Cyrillic letters, with nulls or with a stem shorter than ``STEM`` teach nothing.
    Of paradigms with equally many tokens the one that cuts less counts, then the smaller ``add``.
    """
    given = lemmas.select("token", "lemma").where(F.col("token").rlike(CYRILLIC) & F.col("lemma").isNotNull()).distinct()
    stem = common_prefix(F.col("token"), F.col("lemma"))
    shown = given.withColumn("stem", stem).where(F.col("stem") >= STEM).select("token", (F.length("token") - F.col("stem")).cast("int").alias("cut"), F.expr("substring(lemma, stem + 1)").alias("add"))
    size = F.sequence(F.greatest(F.col("cut"), F.lit(1)), F.least(F.lit(longest), F.length("token") - STEM))
    usable = shown.where((F.col("cut") <= longest) & (F.length("token") - STEM >= F.greatest(F.col("cut"), F.lit(1))))
    endings = usable.select(F.explode(size).alias("size"), "token", "cut", "add").select(F.expr("right(token, size)").alias("ending"), "cut", "add")
    counted = endings.groupBy("ending", "cut", "add").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    best = store.materialise(counted.groupBy("ending").agg(F.min(F.struct((-F.col("n")).alias("fewer"), "cut", "add")).alias("best")).select("ending", "best.cut", "best.add", (-F.col("best.fewer")).alias("n")), "ending-rules")
    shorter = best.select(F.col("ending").alias("_parent"), F.col("cut").alias("_cut"), F.col("add").alias("_add"))
    joined = best.join(shorter, (F.expr("substring(ending, 2)") == F.col("_parent")) & (F.col("cut") == F.col("_cut")) & (F.col("add") == F.col("_add")), "left_anti")
    return joined.select("ending", "cut", "add", "n")


def guessed(tokens: DataFrame, found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(token, lemma) of distinct tokens (token) by ``found`` rules; tokens without Cyrillic letters or without a rule are left out."""
    asked = tokens.select("token").where(F.col("token").rlike(CYRILLIC) & (F.length("token") > STEM)).distinct()
    ends = asked.select("token", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("token") - STEM))).alias("size"))
    met = ends.withColumn("ending", F.expr("right(token, size)")).join(found.select("ending", "cut", "add"), "ending").where(F.length("token") - F.col("cut") >= STEM)
    longest_one = met.groupBy("token").agg(F.max_by(F.struct("cut", "add"), "size").alias("rule"))
    return longest_one.select("token", F.expr("concat(left(token, length(token) - rule.cut), rule.add)").alias("lemma"))


def tokens_of(texts: list[tuple[DataFrame, str]]) -> DataFrame:
    """(token): the distinct tokens of some columns of texts."""
    rows = [frame.select(F.explode(raw_tokens(F.col(column))).alias("token")) for frame, column in texts]
    return reduce(DataFrame.unionByName, rows).distinct()


def extended(lemmas: DataFrame, tokens: DataFrame) -> DataFrame:
    """The dictionary with guesses for those of ``tokens`` (token) that it lacks. What it has stays as it is."""
    unknown = tokens.join(lemmas.select("token"), "token", "left_anti")
    return store.materialise(lemmas.select("token", "lemma").unionByName(guessed(unknown, rules(lemmas))), "lemmas")
