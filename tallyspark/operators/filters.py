"""Row filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.codes import ALLOWED_CODES, is_allowed
from tallyspark.functions.common import as_col, strip
from tallyspark.functions.dates import extend_period, quarter_end_col, quarter_start_col
from tallyspark.functions.text import is_empty_id
from tallyspark.operators.dedup import nulls_last


def filter_codes(df: DataFrame, code_col, allowed: Iterable[str] = ALLOWED_CODES) -> DataFrame:
    """Keep rows whose cleaned code is in ``allowed`` (an ``InSet``)."""
    return df.where(is_allowed(code_col, allowed))


def _bounds(period):
    start, end = period
    to_ts = lambda d: F.lit(dt.datetime.combine(d, dt.time()) if isinstance(d, dt.date)
                            and not isinstance(d, dt.datetime) else d).cast("timestamp_ntz")
    return to_ts(start), to_ts(end)


def in_period(date_col, period) -> Column:
    """Inclusive ``start <= d <= end``; both ends are midnight timestamps."""
    s, e = _bounds(period)
    return as_col(date_col).cast("timestamp_ntz").between(s, e)


def filter_period(df: DataFrame, date_col: str, period) -> DataFrame:
    """Inclusive period filter. No period, or no such column → no filter;
    NULL dates drop out when a period is active."""
    if period is None or (isinstance(date_col, str) and date_col not in df.columns):
        return df
    return df.where(in_period(date_col, period))


def filter_period_extended(df: DataFrame, date_col: str, period, days: int = 8) -> DataFrame:
    """As P3 with the end moved ``days`` later."""
    return filter_period(df, date_col, extend_period(period, days))


def filter_file_period(df: DataFrame, date_col, name_col="_src", days: int = 0) -> DataFrame:
    """F18 + P3/P4 over many files: each row is held against the quarter in the name of its own
    file (its end ``days`` later). Rows of files without a quarter stay; NULL dates
    drop out where there is one. The quarter is a function of the name, so no table of files
    is joined; :func:`tallyspark.sources.read_exports` leaves whole files out before the scan."""
    start, end = quarter_start_col(name_col), quarter_end_col(name_col, days)
    day = as_col(date_col).cast("timestamp_ntz")
    return df.where(start.isNull() | day.between(start.cast("timestamp_ntz"), end.cast("timestamp_ntz")))


def filter_date_range(df: DataFrame, date_col, start, end) -> DataFrame:
    """P5: explicit inclusive range."""
    return df.where(in_period(date_col, (start, end)))


def filter_period_fallback(df: DataFrame, primary, fallback, period,
                           primary_text=None) -> DataFrame:
    """Filter on ``primary`` when any row has a non-blank value in it
    (``primary_text``, default ``primary``), otherwise on ``fallback``.

    The "any non-blank" test is a scalar subquery evaluated once by Spark, not
    a driver round trip, so the whole filter stays one lazy plan.
    """
    probe = as_col(primary_text if primary_text is not None else primary)
    has_primary = df.select(
        F.max(F.when(strip(F.coalesce(probe.cast("string"), F.lit(""))) != "", 1).otherwise(0))
    ).scalar()
    return df.where(F.when(has_primary == 1, in_period(primary, period))
                    .otherwise(in_period(fallback, period)))


def filter_period_if_filled(df: DataFrame, date_col, period, text_col=None) -> DataFrame:
    """P6, second form: filter on ``date_col`` only when some row has a
    non-blank value in it (``text_col``, default the column itself); else
    keep all rows. Applied after another period filter this is the "both in
    turn" variant of the scripts. One scalar subquery, no driver round trip.
    """
    if period is None:
        return df
    probe = F.col(text_col) if isinstance(text_col, str) else (text_col if text_col is not None
                                                               else as_col(date_col))
    filled = df.select(
        F.max(F.when(strip(F.coalesce(probe.cast("string"), F.lit(""))) != "", 1).otherwise(0))
    ).scalar()
    return df.where((filled == 0) | in_period(date_col, period))


def with_empty_flag(df: DataFrame, id_col, rule: str = "tokens", name: str = "is_empty") -> DataFrame:
    """One pass, a boolean flag instead of two filtered copies."""
    return df.withColumn(name, is_empty_id(id_col, rule))


def cap_rows(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """The first ``n`` rows in an explicit order (display cap only;
    summaries are always computed over all rows)."""
    return df.orderBy(*nulls_last(order)).limit(n)
