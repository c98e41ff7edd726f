"""White space and case cleaning shared by the operators on hand-typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode white space character, the no-break space included.
SPACE = r"(?U)\s+"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def squeeze(value: Column) -> Column:
    """Runs of white space made one space, both ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(value, SPACE, " "))


def clean(value: Column) -> Column:
    """``squeeze`` and lower case; null stays null."""
    return F.lower(squeeze(value))


def strip_ends(value: Column) -> Column:
    """Both ends trimmed of every Unicode white space."""
    return F.regexp_replace(value, EDGE_SPACE, "")
