"""Scalar functions: SURVEY F1–F20 with the edge fixtures G3–G8, G14, G15."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import (
    amount_key, blank_null_tokens, is_empty_id, net_amount, normalize_id, parse_date,
    parse_number_comma, parse_number_it, parse_number_mixed, parse_number_plain, quarter_from_name,
    quarter_start_col, sign_multiplier, signed_amount, text_key, to_money,
)
from conftest import strings

G3 = ["1.234,56", "1234.56", "1.234", "1,5", "1.234.567", "abc", "", "1d"]


def _col(spark, values, fn):
    df = strings(spark, ["s"], [[v] for v in values])
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_mixed_locale_g3(spark):
    out = _col(spark, G3, parse_number_mixed)
    assert out[:4] == [Decimal("1234.56"), Decimal("1234.56"), Decimal("1.234"), Decimal("1.5")]
    assert out[4:] == [None, None, None, None]
    assert _col(spark, ["abc"], lambda c: parse_number_mixed(c, default=0)) == [Decimal(0)]


def test_strict_italian_g4(spark):
    out = _col(spark, G3, parse_number_it)
    assert out[:5] == [Decimal("1234.56"), Decimal("123456"), Decimal("1234"), Decimal("1.5"), Decimal("1234567")]
    assert out[5:] == [None, None, None]


def test_comma_and_plain(spark):
    assert _col(spark, ["1.234,56", "12,5", " 7 "], parse_number_comma) == [None, Decimal("12.5"), Decimal("7")]
    assert _col(spark, ["1.234,56", "12.5", "inf", "1e2"], parse_number_plain) == [None, Decimal("12.5"), None,
                                                                                   Decimal("100")]


def test_dates_g5(spark):
    vals = ["2025-01-05", "2025-01-05 00:00:00", "05/01/2025", "5/1/2025", "bad"]
    out = _col(spark, vals, parse_date)
    assert out[:4] == [dt.datetime(2025, 1, 5)] * 4 and out[4] is None
    # month-first (register report) reads the same text as 5 May
    assert _col(spark, ["05/01/2025"], lambda c: parse_date(c, day_first=False)) == [dt.datetime(2025, 5, 1)]
    # per-row formats: one odd value does not null the others (H3 iii)
    assert _col(spark, ["31/01/2025 10:00:00", "01/02/2025"], parse_date) == [
        dt.datetime(2025, 1, 31, 10), dt.datetime(2025, 2, 1)]


def test_sign_g6(spark):
    df = strings(spark, ["sign"], [["A"], ["a"], [" A "], ["D"], [None]])
    out = [r[0] for r in df.select(signed_amount(F.lit(10), "sign")).collect()]
    assert out == [Decimal("-10.00")] * 3 + [Decimal("10.00")] * 2
    assert [r[0] for r in df.select(sign_multiplier("sign")).collect()] == [-1, -1, -1, 1, 1]


def test_net_g7(spark):
    df = strings(spark, ["code", "sign"], [["EL", "D"], ["2EL", "D"], ["L", "D"], ["EP", "D"], ["EL", "A"]])
    out = [r[0] for r in df.select(net_amount(F.lit(100), "sign", "code", F.lit(20))).collect()]
    assert out == [Decimal("80.00")] * 3 + [Decimal("100.00"), Decimal("-80.00")]


def test_half_even_rounding(spark):
    df = strings(spark, ["s"], [["2.665"], ["2.675"]])
    assert [r[0] for r in df.select(to_money(parse_number_plain("s"))).collect()] == [Decimal("2.66"), Decimal("2.68")]


def test_ids_g8(spark):
    vals = ["123", "123.0", "123.00", "12.50", " ID1 ", None]
    assert _col(spark, vals, normalize_id) == ["123", "123", "123", "12.50", "ID1", ""]


def test_empty_rules_fx5(spark):
    vals = ["0,0", "0", "123", "", None, "nan", "None", "-"]
    assert _col(spark, vals, lambda c: is_empty_id(c, "tokens")) == [False, False, False, True, True, True, True, False]
    assert _col(spark, vals, lambda c: is_empty_id(c, "tokens_zero")) == [True, True, False, True, True, True, True, False]
    assert _col(spark, vals, lambda c: is_empty_id(c, "strict")) == [False, False, False, True, True, False, False, False]
    assert _col(spark, vals, lambda c: is_empty_id(c, "dash")) == [False, False, False, True, True, True, True, True]


def test_text_and_amount_keys_g14(spark):
    assert _col(spark, [" ab ", None], text_key) == ["AB", ""]
    assert _col(spark, ["nan", "NULL", "x", None], blank_null_tokens) == ["", "", "x", ""]
    df = spark.range(1).select(amount_key(signed_amount(F.lit(0), F.lit("A"))).alias("k"),
                               amount_key(F.lit("12.5")).alias("k2"))
    assert tuple(df.first()) == ("0.00", "12.50")


def test_quarter_g15(spark):
    assert quarter_from_name("Fatture Registro Pagato I° Trim.2026.csv") == (dt.date(2026, 1, 1), dt.date(2026, 3, 31))
    assert quarter_from_name("x IV TRIMESTRE 2025") == (dt.date(2025, 10, 1), dt.date(2025, 12, 31))
    assert quarter_from_name("y 2 trim 2026") == (dt.date(2026, 4, 1), dt.date(2026, 6, 30))
    assert quarter_from_name("plain.csv") is None
    assert _col(spark, ["a III trim-2024.xlsx", "plain"], quarter_start_col) == [dt.date(2024, 7, 1), None]


def test_dates_random_roundtrip(spark):
    """Random timestamps rendered in every accepted shape parse back; a
    day/month swap parses month-first; impossible dates are NULL."""
    import random
    rnd = random.Random(5)
    cases = []
    for _ in range(400):
        d = dt.datetime(rnd.randint(1990, 2030), rnd.randint(1, 12), rnd.randint(1, 28),
                        rnd.randint(0, 23), rnd.randint(0, 59), rnd.randint(0, 59))
        day_only = d.replace(hour=0, minute=0, second=0)
        sep = rnd.choice("/-.")
        cases += [
            (d.strftime("%Y-%m-%d %H:%M:%S"), d, d),
            (d.strftime("%Y-%m-%d"), day_only, day_only),
            (f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year}", day_only, None),
            (f"{d.day}{sep}{d.month}{sep}{d.year} {d.hour}:{d.minute:02d}", d.replace(second=0), None),
            (f"{d.day}/{d.month}/{d.year} {d.hour}:{d.minute:02d}:{d.second:02d}", d, None),
            (f"{d.month}/{d.day}/{d.year}", None, day_only),
        ]
    cases += [("31/02/2025", None, None), ("2025-13-01", None, None), ("00/01/2025", None, None)]
    df = strings(spark, ["s"], [[c[0]] for c in cases])
    got = {r.s: (r.df, r.mf) for r in df.select("s", parse_date("s").alias("df"),
                                                parse_date("s", day_first=False).alias("mf")).collect()}
    for s, exp_df, exp_mf in cases:
        g_df, g_mf = got[s]
        if exp_df is not None:
            assert g_df == exp_df, s
        if exp_mf is not None:
            assert g_mf == exp_mf, s
        if exp_df is None and exp_mf is None:
            assert g_df is None and g_mf is None, s
