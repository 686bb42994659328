"""Small helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return c if isinstance(c, Column) else F.col(c)


# Characters Python's ``str.isspace()`` accepts: what ``str.strip()`` removes.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")


def strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode white space (tabs, NBSP …),
    which Spark's ``trim`` (blanks only) does not. ``btrim`` with an explicit
    character set, no regular expression."""
    return F.btrim(as_col(c).cast("string"), F.lit(WHITESPACE))
