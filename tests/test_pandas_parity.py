"""The number parsers on texts whose value is known, because each is rendered
from a number: sign, grouping, decimal mark, fraction and padding are drawn at
random, and the expected value follows from the drawn parts."""

import random

from tallyspark.functions import parse_number_comma, parse_number_it, parse_number_mixed, parse_number_plain


def _rendered(rnd):
    whole, cents = rnd.choice([0, 7, 42, 999, 1000, 123456, 9876543]), rnd.randint(0, 99)
    sign = rnd.choice(["", "-", "+"])
    group, mark = rnd.choice([("", "."), ("", ","), (".", ","), (" ", ","), ("", "")])
    pad = rnd.choice(["", " ", "\t", "\u00a0"])
    digits = f"{whole:,}".replace(",", group)
    text = sign + digits + (f"{mark}{cents:02d}" if mark else "")
    value = whole + (cents / 100 if mark else 0)
    return text, pad, group if whole >= 1000 else "", mark, -value if sign == "-" else value, cents, whole


def test_rendered_numbers(spark):
    rnd = random.Random(11)
    cases = [_rendered(rnd) for _ in range(600)]
    df = spark.createDataFrame([(i, c[1] + c[0] + c[1]) for i, c in enumerate(cases)], "i int, s string")
    got = {r.i: r for r in df.select("i", parse_number_mixed("s").cast("double").alias("m"), parse_number_it("s").cast("double").alias("it"),
                                     parse_number_comma("s").cast("double").alias("c"), parse_number_plain("s").cast("double").alias("p")).collect()}
    for i, (text, pad, group, mark, value, cents, whole) in enumerate(cases):
        sign = -1 if value < 0 else 1
        # without a decimal comma a point is the decimal mark of the mixed style, and always a separator of the Italian one
        it = sign * (whole * 100 + cents) if mark == "." else value
        ascii_pad = pad != "\u00a0"
        comma = value if ascii_pad and not group else None
        plain = value if ascii_pad and not group and mark != "," else None
        for name, want in (("m", value), ("it", it), ("c", comma), ("p", plain)):
            have = got[i][name]
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-6), (repr(pad + text), name, have, want)


def test_not_numbers_and_large_numbers(spark):
    from tallyspark.functions import net_amount, signed_amount, to_money
    from tallyspark.functions.numbers import out_of_range
    texts = ["nan", "inf", "1d", "-", "", "n/d", "1.2.3", "12345678901234567,5", "9" * 30, None]
    rows = {r.s: r for r in spark.createDataFrame([(t,) for t in texts], "s string").select(
        "s", parse_number_mixed("s", default=0).alias("v"), out_of_range("s").alias("big"),
        to_money(parse_number_mixed("s")).cast("string").alias("money"),
        net_amount(parse_number_mixed("s"), "s", "s", "s").alias("net"), signed_amount(parse_number_mixed("s"), "s").alias("signed")).collect()}
    assert all(rows[t].v == 0 and not rows[t].big for t in ("nan", "inf", "1d", "-", "", "n/d", "1.2.3", None))
    assert rows["12345678901234567,5"].money == "12345678901234567.50" and not rows["12345678901234567,5"].big
    assert rows["9" * 30].v is None and rows["9" * 30].big  # counted, not zeroed
