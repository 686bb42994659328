"""Text keys, id normalisation and empty-id rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.common import as_col, strip
from tallyspark.functions.numbers import MONEY_TYPE, PARSE_TYPE, to_money

# Textual stand-ins for "missing" (lower-cased comparison).
NULL_TOKENS = ("", "nan", "none", "null")
# Exact-match blanks of the id check script (rule N4).
DASH_TOKENS = ("", "nan", "None", "nan ", " ", "-")
# Tokens blanked by the analysis scripts before grouping.
BLANKED_TOKENS = ("nan", "None", "none", "NULL", "null")


def text_key(c) -> Column:
    """F8: NULL → "", Unicode strip, upper case."""
    return F.upper(strip(F.coalesce(as_col(c).cast("string"), F.lit(""))))


def amount_key(c) -> Column:
    """amount as 2-decimal text (``100.00``). Decimals have no negative
    zero, so a credited zero matches ``0.00``."""
    return to_money(F.coalesce(as_col(c).try_cast(PARSE_TYPE), F.lit(0).cast(PARSE_TYPE))).cast("string")


def normalize_id(c) -> Column:
    """NULL → "", stripped, integral float text ``123.0`` → ``123``."""
    s = strip(as_col(c).cast("string"))
    return F.coalesce(F.regexp_replace(s, r"^(\d+)\.0+$", "$1"), F.lit(""))


def is_empty_id(c, rule: str = "strict") -> Column:
    """the four empty-id rules.

    * ``strict`` (N1): empty after NULL → "" and strip.
    * ``tokens`` (N2): lower-cased stripped value in :data:`NULL_TOKENS`;
      ``0`` is a real id.
    * ``tokens_zero`` (N3): N2, or the value (',' read as '.') is numeric 0.
    * ``dash`` (N4): exact match with :data:`DASH_TOKENS` after a blank trim,
      NULL counted as empty.
    """
    raw = as_col(c).cast("string")
    if rule == "strict":
        return strip(F.coalesce(raw, F.lit(""))) == ""
    if rule in ("tokens", "tokens_zero"):
        norm = F.lower(strip(F.coalesce(raw, F.lit(""))))
        empty = norm.isin(*NULL_TOKENS)
        if rule == "tokens_zero":
            num = F.replace(norm, F.lit(","), F.lit("."))
            is_num = num.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
            empty = empty | (is_num & (num.try_cast("double") == 0))
        return empty
    if rule == "dash":
        return raw.isNull() | F.trim(raw).isin(*DASH_TOKENS)
    raise ValueError(f"unknown empty-id rule {rule!r}")


def blank_null_tokens(c) -> Column:
    """textual NULL tokens → ""."""
    raw = as_col(c).cast("string")
    return F.when(raw.isNull() | raw.isin(*BLANKED_TOKENS), F.lit("")).otherwise(raw)


__all__ = ["text_key", "amount_key", "normalize_id", "is_empty_id", "blank_null_tokens",
           "NULL_TOKENS", "DASH_TOKENS", "BLANKED_TOKENS", "MONEY_TYPE"]
