"""Date parsing and quarter periods.

One parser with a ``day_first`` switch replaces the two pandas behaviours of
the source (month-first in the register report, day-first in the
comparison). Each row is parsed on its own: unlike pandas, one odd value does
not change how the other rows are read.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.common import as_col, strip

# The shapes of date texts that are read.
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d+)?)?$"
# Day/month/year text with '/', '-' or '.' separators and an optional time.
DMY_TEXT = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}( \d{1,2}:\d{2}(:\d{2})?)?$"
YMD_TEXT = r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$"


def parse_date(c, day_first: bool = True) -> Column:
    """text → ``timestamp_ntz``, NULL when the text is not a date.

    ISO text (``yyyy-MM-dd`` with optional time) is read as ISO; numeric
    day/month/year text day-first (``05/01/2025`` = 5 January) or, with
    ``day_first=False``, month-first. The shape of each value picks exactly
    one format (a regular expression test), so no row pays for failed parse
    attempts.
    """
    raw = as_col(c).cast("string")
    s = strip(raw)
    dmy = F.translate(s, ".-", "//")
    n_colons = F.length(raw) - F.length(F.replace(raw, F.lit(":"), F.lit("")))
    base = "d/M/yyyy" if day_first else "M/d/yyyy"
    other = (F.when(n_colons == 0, F.try_to_timestamp(dmy, F.lit(base)))
              .when(n_colons == 1, F.try_to_timestamp(dmy, F.lit(base + " H:mm")))
              .otherwise(F.try_to_timestamp(dmy, F.lit(base + " H:mm:ss"))))
    parsed = (F.when(s.rlike(ISO_TEXT), s.try_cast("timestamp_ntz"))
               .when(s.rlike(DMY_TEXT), other.cast("timestamp_ntz"))
               .when(s.rlike(YMD_TEXT), F.try_to_timestamp(F.replace(s, F.lit("/"), F.lit("-")),
                                                            F.lit("yyyy-M-d")).cast("timestamp_ntz")))
    return parsed


def date_text(c) -> Column:
    """``yyyy-MM-dd`` text, empty string when the date is missing."""
    return F.coalesce(F.date_format(as_col(c), "yyyy-MM-dd"), F.lit(""))


def month_of(c) -> Column:
    """``yyyy-MM``; NULL stays NULL (the source turned it into "NaT")."""
    return F.date_format(as_col(c), "yyyy-MM")


# How a file name names its quarter — roman I–IV or 1–4,
# optional degree sign, "TRIM" / "TRIMESTRE" with optional dot, separators,
# then a year 20xx. Searched anywhere in the upper-cased name.
QUARTER_IN_NAME = re.compile(r"(I{1,3}|IV|[1-4])\s*°?\s*TRIM(?:ESTRE)?\.?\s*[-_ ]*(20\d{2})")
ROMAN_QUARTERS = {"I": 1, "II": 2, "III": 3, "IV": 4}


def quarter_from_name(name: str) -> tuple[dt.date, dt.date] | None:
    """F18 (driver side, one string): ``(first day, last day)`` or None."""
    m = QUARTER_IN_NAME.search(str(name).upper())
    if not m:
        return None
    q_raw, year = m.group(1), int(m.group(2))
    q = ROMAN_QUARTERS.get(q_raw) or int(q_raw)
    start = dt.date(year, 3 * q - 2, 1)
    nxt = dt.date(year + (q == 4), 1 if q == 4 else 3 * q + 1, 1)
    return start, nxt - dt.timedelta(days=1)


def extend_period(period, days: int = 8):
    """the quarter with its end moved ``days`` later."""
    if period is None:
        return None
    start, end = period
    return start, end + dt.timedelta(days=days)


def quarter_start_col(name_col) -> Column:
    """F18 as a Column, for many files at once (e.g. ``_metadata.file_name``):
    first day of the quarter named in the file name, NULL when none."""
    up = F.upper(as_col(name_col))
    pat = QUARTER_IN_NAME.pattern
    q_raw = F.regexp_extract(up, pat, 1)
    year = F.regexp_extract(up, pat, 2)
    q = (F.when(q_raw == "IV", 4).when(q_raw == "III", 3).when(q_raw == "II", 2)
         .when(q_raw == "I", 1).otherwise(q_raw.try_cast("int")))
    return F.when(q_raw != "", F.make_date(year.try_cast("int"), q * 3 - 2, F.lit(1)))


def quarter_end_col(name_col, days: int = 0) -> Column:
    """F18/F19 as a Column: last day of the quarter named in the file name, ``days`` later; NULL when none."""
    return F.date_add(F.last_day(F.add_months(quarter_start_col(name_col), 2)), days)
