"""Numeric intervals and quantities in texts, as Column expressions over regular expression matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS, normalise

# Surface units in order of preference, comparators, patterns.
UNITS = (
    ("мас.%", "pct_mass"), ("мас. %", "pct_mass"), ("масс.%", "pct_mass"), ("об.%", "pct_vol"), ("об. %", "pct_vol"),
    ("см3", "cm3"), ("куб.см", "cm3"), ("г/м2", "gsm"), ("дтекс", "dtex"), ("текс", "tex"), ("мкм", "um"), ("мм", "mm"),
    ("квт", "kw"), ("мпа", "mpa"), ("кг", "kg"), ("лет", "year"), ("года", "year"), ("год", "year"), ("дюйм", "inch"),
    ("карат", "carat"), ("%", "pct"),
)
LOWER_STRICT = ("более", "свыше", "выше")
LOWER = ("не менее", "от")
UPPER_STRICT = ("менее", "ниже")
COMPARED = r"(не более|не менее|не превышает|более|менее|свыше|выше|ниже|от|до)\s*(\d+(?:[.,]\d+)?)\s*([а-яё0-9./%]*)"
QUANTITY = r"(\d+(?:[.,]\d+)?)\s*([а-яё0-9./%]+)"
#: Characters before a match in which its subject is looked for.
REACH = 60


_NAMES = {surface: canon for surface, canon in UNITS}
#: The first surface form, in order of preference, that stands at the beginning; no form begins or ends with a character that is skipped there.
_SURFACE = "^[ .,;]*(" + "|".join(re.escape(surface) for surface, _ in UNITS) + ")"


def unit(raw: Column) -> Column:
    """The canonical unit whose surface form the text begins with; null if none."""
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return F.try_element_at(names, F.regexp_extract(raw, _SURFACE, 1))


def family(canon: Column) -> Column:
    """Percentages of every kind are one family."""
    return F.when(F.startswith(canon, F.lit("pct")), F.lit("pct")).otherwise(canon)


def _value(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit(".")).cast("double")


def _subject(before: Column) -> Column:
    """Distinct Cyrillic words of more than two letters in the characters before a match, no stop words."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    words = F.regexp_extract_all(F.right(before, F.lit(REACH)), F.lit("[а-яё]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def matches(norm: Column, pattern: str, groups: int) -> dict[str, Column]:
    """Arrays g1.. of each match's groups, and ``marked``: the text split before each match."""
    pattern = f"(?U){pattern}"
    found = {f"g{g}": F.regexp_extract_all(norm, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)}
    return found | {"marked": F.split(F.regexp_replace(norm, pattern, "\u0001$0"), "\u0001")}


def _before(marked: Column, i: Column) -> Column:
    """At least the REACH characters before match ``i``: parts have one or more, so so many parts are enough."""
    return F.array_join(F.slice(marked, F.greatest(i + 2 - REACH, F.lit(1)), F.least(i + 1, F.lit(REACH))), "")


def comparisons(m: dict[str, Column]) -> Column:
    """Comparisons with a known unit: (word, value, unit, is_lower, strict, subject), in order."""
    made = F.transform(
        m["g1"],
        lambda w, i: F.struct(
            w.alias("word"), _value(F.get(m["g2"], i)).alias("value"), unit(F.get(m["g3"], i)).alias("unit"),
            w.isin(*LOWER_STRICT, *LOWER).alias("is_lower"), w.isin(*LOWER_STRICT, *UPPER_STRICT).alias("strict"), _subject(_before(m["marked"], i)).alias("subject"),
        ),
    )
    return F.filter(made, lambda x: x["unit"].isNotNull())


def intervals(found: Column) -> Column:
    """Intervals (unit, lo, lo_strict, hi, hi_strict, subject) from the comparisons of a text.

    An upper bound right after a lower bound of the same unit closes it; every other bound is an
    interval of its own. A lower bound always opens one, so a bound's neighbours decide.
    """
    none, no = F.lit(None).cast("double"), F.lit(False)

    def merged(m: Column, i: Column) -> Column:
        prev, after = F.get(found, i - 1), F.get(found, i + 1)
        closes = ~m["is_lower"] & F.coalesce(prev["is_lower"] & (prev["unit"] == m["unit"]), no)
        closed = m["is_lower"] & F.coalesce(~after["is_lower"] & (after["unit"] == m["unit"]), no)
        one = F.struct(
            m["unit"].alias("unit"), F.when(m["is_lower"], m["value"]).alias("lo"), (m["is_lower"] & m["strict"]).alias("lo_strict"),
            F.when(~m["is_lower"], m["value"]).otherwise(F.when(closed, after["value"]).otherwise(none)).alias("hi"),
            F.when(~m["is_lower"], m["strict"]).otherwise(closed & F.coalesce(after["strict"], no)).alias("hi_strict"),
            F.when(closed, F.array_union(m["subject"], after["subject"])).otherwise(m["subject"]).alias("subject"),
        )
        return F.when(~closes, one)

    return F.filter(F.transform(found, merged), lambda x: x.isNotNull())


def quantities(m: dict[str, Column], subjects: bool = True) -> Column:
    """Quantities with a known unit: (unit, value, and subject if wanted), in order."""
    subject = lambda i: [_subject(_before(m["marked"], i)).alias("subject")] if subjects else []
    made = F.transform(m["g1"], lambda v, i: F.struct(unit(F.get(m["g2"], i)).alias("unit"), _value(v).alias("value"), *subject(i)))
    return F.filter(made, lambda x: x["unit"].isNotNull())


def contains(interval: Column, value: Column) -> Column:
    """Whether the interval holds the value; a missing bound is open."""
    above = F.when(interval["lo_strict"], value > interval["lo"]).otherwise(value >= interval["lo"])
    below = F.when(interval["hi_strict"], value < interval["hi"]).otherwise(value <= interval["hi"])
    return F.coalesce(above, F.lit(True)) & F.coalesce(below, F.lit(True))
