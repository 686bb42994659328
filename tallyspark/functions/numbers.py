"""Text → number parsers and money arithmetic.

All parsers return ``decimal(34,8)`` (exact) or NULL on failure; money is
rounded half-even to ``decimal(28,2)`` with :func:`to_money`. Both hold 26
digits before the point. A number beyond that is NULL, never 0, whatever the
default for text that isn't a number, and :func:`out_of_range` tells such rows
so that jobs can count them. Nothing here leaves the JVM: every function builds a
Catalyst expression.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.common import as_col, strip

PARSE_TYPE = "decimal(34,8)"
MONEY_TYPE = "decimal(28,2)"
SUM_TYPE = "decimal(38,2)"

# A plain decimal literal after locale clean-up: optional sign, digits with an
# optional fraction, optional exponent. Spark's cast would also accept "1d",
# "1f" and "Infinity", which a ledger must treat as garbage.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# What pandas' number parser skips around a number.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast(PARSE_TYPE), text.try_cast("double").try_cast(PARSE_TYPE))


def _numeric_or_null(text: Column) -> Column:
    """Exact decimal parse of a plain numeric literal; literals the decimal
    cast rejects although they are in range (e.g. ``0E0138``) go through
    double."""
    return F.when(text.rlike(NUMERIC_TEXT), _number(text))


def _with_default(text: Column, default) -> Column:
    """The number, or ``default`` for text that isn't one (a number that
    can't be held stays NULL)."""
    out = _numeric_or_null(text)
    return out if default is None else out.otherwise(F.lit(default).cast(PARSE_TYPE))


def _no_spaces(c) -> Column:
    return strip(F.replace(as_col(c).cast("string"), F.lit(" "), F.lit("")))


def _mixed_text(c) -> Column:
    # the marks are looked for in the raw text, so that the text is stripped once
    raw, s = as_col(c).cast("string"), _no_spaces(c)
    both = raw.contains(".") & raw.contains(",")
    return F.replace(F.when(both, F.replace(s, F.lit("."), F.lit(""))).otherwise(s), F.lit(","), F.lit("."))


def _comma_text(c) -> Column:
    return F.replace(F.btrim(as_col(c).cast("string"), F.lit(ASCII_SPACE)), F.lit(","), F.lit("."))


def out_of_range(c, style: str = "mixed") -> Column:
    """Whether the text is a number (in the ``mixed`` or ``comma`` style) that
    the exact types can't hold."""
    text = _mixed_text(c) if style == "mixed" else _comma_text(c)
    return F.coalesce(text.rlike(NUMERIC_TEXT) & to_money(_number(text)).isNull(), F.lit(False))


def parse_number_mixed(c, default=None) -> Column:
    """mixed locale. Spaces dropped; when both '.' and ',' occur the dots
    are thousands separators; then ',' is the decimal mark.

    ``1.234,56`` → 1234.56, ``1234.56`` → 1234.56, ``1.234`` → 1.234,
    ``1,5`` → 1.5, ``1.234.567`` → fail. ``default`` replaces failures
    (the single-ledger jobs use 0, the comparison keeps NULL).
    """
    return _with_default(_mixed_text(c), default)


def parse_number_it(c, default=None) -> Column:
    """strict Italian. Every '.' is a thousands separator, ',' the
    decimal mark: ``1234.56`` → 123456, ``1.234`` → 1234."""
    s = F.replace(_no_spaces(c), F.lit("."), F.lit(""))
    return _with_default(F.replace(s, F.lit(","), F.lit(".")), default)


def parse_number_comma(c, default=None) -> Column:
    """only ',' → '.'; ``1.234,56`` fails."""
    return _with_default(_comma_text(c), default)


def parse_number_plain(c, default=None) -> Column:
    """plain coercion, no locale handling (``1.234,56`` fails)."""
    return _with_default(F.btrim(as_col(c).cast("string"), F.lit(ASCII_SPACE)), default)


def to_money(c) -> Column:
    """Round half-even to 2 digits as ``decimal(28,2)`` (NULL if too large).

    A direct cast rounds half-up; ``bround`` first.
    """
    return F.bround(as_col(c).try_cast(PARSE_TYPE), 2).try_cast(MONEY_TYPE)


def sign_multiplier(sign, credit: str = "A") -> Column:
    """-1 when the trimmed, upper-cased sign equals ``credit``, else +1
    (NULL sign → +1)."""
    s = F.upper(strip(F.coalesce(as_col(sign).cast("string"), F.lit(""))))
    return F.when(s == F.lit(credit), F.lit(-1)).otherwise(F.lit(1))


def signed_amount(amount, sign, credit: str = "A") -> Column:
    """amount × sign multiplier, rounded half-even to cents."""
    # negated, not multiplied: a decimal product would give up digits of the fraction
    a = to_money(amount)
    return F.when(sign_multiplier(sign, credit) == -1, -a).otherwise(a)


# Protocol codes whose paid amount is net of withholding.
NET_OF_WITHHOLDING_CODES = ("EL", "2EL", "L")


def net_amount(amount, sign, code, withholding,
               adj_codes: Iterable[str] = NET_OF_WITHHOLDING_CODES, credit: str = "A") -> Column:
    """signed amount, minus the signed withholding for ``adj_codes``.

    The code is compared trimmed and upper-cased; both terms are rounded to
    cents before subtracting, as the ledgers are.
    """
    a = signed_amount(amount, sign, credit)
    w = signed_amount(F.coalesce(as_col(withholding).try_cast(PARSE_TYPE), F.lit(0).cast(PARSE_TYPE)),
                      sign, credit)
    k = F.upper(strip(F.coalesce(as_col(code).cast("string"), F.lit(""))))
    return F.when(k.isin(*list(adj_codes)), to_money(a - w)).otherwise(a)


def taxable(total, vat) -> Column:
    """F16: taxable amount = invoice total − VAT."""
    return as_col(total).try_cast(PARSE_TYPE) - as_col(vat).try_cast(PARSE_TYPE)
