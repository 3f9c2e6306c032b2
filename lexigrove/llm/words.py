"""Words as the contracts of this subpackage define them, as Column expressions and for Python tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a longest run of characters other than space and \\t \\n \\v \\f \\r.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = "[\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_array(text: Column) -> Column:
    """The words of a text in order; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")
