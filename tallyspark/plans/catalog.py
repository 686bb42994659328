"""Registered queries: every operator of the inventory applied to the driver
tables, each a ``(spark, sf_dir) -> DataFrame`` built from the library.

The matching DuckDB SQL lives in :mod:`tallyspark.plans.oracle`; column
names agree one to one. Money leaves as double, dates as ``yyyy-MM-dd``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import (
    ALT_ALLOWED_CODES, amount_key, blank_null_tokens, code_dimension, date_text,
    is_empty_id, month_of, net_amount, normalize_id, parse_date, parse_number_comma,
    parse_number_it, parse_number_mixed, parse_number_plain, quarter_from_name, sign_multiplier,
    signed_amount, taxable, text_key, to_money,
)
from tallyspark.functions.codes import ELECTRONIC, PAPER, SELF_INVOICE
from tallyspark.operators import aggregates as agg
from tallyspark.operators import filters as flt
from tallyspark.operators import funnels as fun
from tallyspark.operators import reconcile as rec
from tallyspark.operators.dedup import dedup_first, duplicates_removed
from tallyspark.plans.ledgers import (
    LINE_KEY, LINE_ORDER, finish, money, portal, protocol, read, register, withholding,
)

# ----------------------------------------------------------------- texts
def _money_texts(price) -> dict[str, F.Column]:
    """Locale renderings of a positive 2-decimal amount (< 1e6)."""
    plain = price.cast("decimal(18,2)").cast("string")
    ip = F.floor(price).cast("bigint")
    cents = F.substring(plain, -2, 2)
    hi, lo = (ip / 1000).cast("bigint"), F.lpad((ip % 1000).cast("string"), 3, "0")
    grouped = lambda sep: F.when(ip >= 1000, F.concat(hi.cast("string"), F.lit(sep), lo)) \
        .otherwise(ip.cast("string"))
    return {
        "plain": plain,
        "plain_nbsp": F.concat(F.lit("\u00a0"), plain),
        "comma_tab": F.concat(F.replace(plain, F.lit("."), F.lit(",")), F.lit("\t")),
        "comma": F.replace(plain, F.lit("."), F.lit(",")),
        "it": F.concat(grouped("."), F.lit(","), cents),
        "spaced": F.concat(grouped(" "), F.lit(","), cents),
        "it_int": grouped("."),
        "junk": F.lit("n/d"),
    }


def _number_texts(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    t = _money_texts(F.col("l_extendedprice"))
    v = F.col("l_linenumber") % 6
    txt = (F.when(v == 0, t["plain_nbsp"]).when(v == 1, t["comma_tab"]).when(v == 2, t["it"])
            .when(v == 3, t["spaced"]).when(v == 4, t["it_int"]).otherwise(t["junk"]))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
                     v.cast("int").alias("v"), txt.alias("txt"))


def parse_numbers_mixed(spark, sf):
    """mixed-locale parse, failures → 0 and failures → NULL."""
    df = _number_texts(spark, sf)
    return finish(df.select("k", "ln", "v", "txt",
                            parse_number_mixed("txt", default=0).alias("mixed0"),
                            parse_number_mixed("txt").alias("mixed")))


def parse_numbers_it(spark, sf):
    """strict Italian parse."""
    df = _number_texts(spark, sf)
    return finish(df.select("k", "ln", "v", "txt", parse_number_it("txt").alias("it")))


def parse_numbers_comma(spark, sf):
    """comma-only and plain coercion."""
    df = _number_texts(spark, sf)
    return finish(df.select("k", "ln", "v", "txt", parse_number_comma("txt").alias("comma"),
                            parse_number_plain("txt").alias("plain")))


def parse_dates(spark, sf):
    """order dates as ISO, ISO+time, dd/MM/yyyy, d/M/yyyy, junk."""
    o = read(spark, sf, "orders")
    d = F.col("o_orderdate")
    v = F.col("o_orderkey") % 5
    txt = (F.when(v == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(v == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
            .when(v == 2, F.date_format(d, "dd/MM/yyyy"))
            .when(v == 3, F.date_format(d, "d/M/yyyy"))
            .otherwise(F.lit("n.d.")))
    df = o.select(F.col("o_orderkey").alias("k"), v.cast("int").alias("v"), txt.alias("txt"))
    day_first = parse_date("txt", day_first=True)
    return df.select("k", "v", "txt", date_text(day_first).alias("day_first"),
                     date_text(parse_date("txt", day_first=False)).alias("month_first"),
                     month_of(day_first).alias("month"))


def normalise_keys(spark, sf):
    """F8–F12 on ids rendered as 123, 123.0, 123.00, ' 123 ', nan, '', NULL, 0."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    v = F.col("o_orderkey") % 8
    raw = (F.when(v == 0, k).when(v == 1, F.concat(k, F.lit(".0"))).when(v == 2, F.concat(k, F.lit(".00")))
            .when(v == 3, F.concat(F.lit(" "), k, F.lit(" "))).when(v == 4, F.lit("nan"))
            .when(v == 5, F.lit("")).when(v == 6, F.lit(None).cast("string")).otherwise(F.lit("0")))
    df = o.select(F.col("o_orderkey").alias("k"), v.cast("int").alias("v"), raw.alias("raw"),
                  F.col("o_totalprice"))
    return df.select("k", "v", "raw", normalize_id("raw").alias("norm_id"),
                     is_empty_id("raw", "strict").alias("empty_strict"),
                     is_empty_id("raw", "tokens").alias("empty_tokens"),
                     is_empty_id("raw", "tokens_zero").alias("empty_tokens_zero"),
                     is_empty_id("raw", "dash").alias("empty_dash"),
                     text_key("raw").alias("text_key"), blank_null_tokens("raw").alias("blanked"),
                     amount_key(money("o_totalprice")).alias("amount_key"))


def signed_net(spark, sf):
    """Sign multiplier, signed amount, net of withholding, taxable."""
    li = read(spark, sf, "lineitem")
    price = money("l_extendedprice")
    vat = to_money(price * F.col("l_tax").cast("decimal(18,2)"))
    df = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
                   protocol().alias("proto"),
                   F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("\t"), "l_returnflag"))
                   .otherwise(F.concat("l_returnflag", F.lit("\u00a0"))).alias("rf"),
                   price.alias("price"), withholding().alias("w"), vat.alias("vat"))
    return finish(df.select(
        "k", "ln", "proto", sign_multiplier("rf").alias("mult"),
        signed_amount("price", "rf").alias("signed"),
        net_amount("price", "rf", "proto", "w").alias("net"),
        to_money(taxable(F.col("price") + F.col("vat"), "vat")).alias("taxable")))


# --------------------------------------------------------------- periods
REGISTER_FILE = "Registro Pagato II TRIM 2000.csv"
PORTAL_FILE = "Portale Pagato 3° trimestre 2000.xlsx"


def period_filter(spark, sf):
    """F18 + P3: quarter named in the register file name, on ship dates."""
    li = read(spark, sf, "lineitem")
    out = flt.filter_period(li, "l_shipdate", quarter_from_name(REGISTER_FILE))
    return finish(out.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
                             F.col("l_shipdate").alias("d"), money("l_extendedprice").alias("amt")))


def period_filter_ext(spark, sf):
    """F19 + P4: portal quarter extended by 8 days, on order dates."""
    o = read(spark, sf, "orders")
    out = flt.filter_period_extended(o, "o_orderdate", quarter_from_name(PORTAL_FILE))
    return finish(out.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"),
                             money("o_totalprice").alias("amt")))


def period_fallback(spark, sf):
    """P5 + P6: a period on a primary date column when it has any non-blank
    value, else on a fallback column. Orders: the primary text is filled for
    status F → primary used. Lines: the primary text is blank everywhere →
    ship date used. Explicit range (P5): the first quarter of 1997."""
    import datetime as dt
    period = (dt.date(1997, 1, 1), dt.date(1997, 3, 31))
    o = read(spark, sf, "orders").withColumn(
        "paid_text", F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.lit("")))
    o = o.withColumn("paid_date", parse_date("paid_text"))
    fo = flt.filter_period_fallback(o, "paid_date", "o_orderdate", period, primary_text="paid_text")
    li = read(spark, sf, "lineitem").withColumn("paid_text", F.lit(" ")) \
        .withColumn("paid_date", parse_date("paid_text"))
    fl = flt.filter_period_fallback(li, "paid_date", "l_shipdate", period, primary_text="paid_text")
    out = (fo.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("k"),
                     F.lit(0).alias("ln"), F.col("o_orderdate").alias("d"))
           .unionByName(fl.select(F.lit("lineitem").alias("source"), F.col("l_orderkey").alias("k"),
                                  F.col("l_linenumber").alias("ln"), F.col("l_shipdate").alias("d"))))
    return finish(out)


# ----------------------------------------------------------------- dedup
def _lines_with_proto(spark, sf):
    return read(spark, sf, "lineitem").withColumn("proto", protocol())


def _line_rows(df):
    return finish(df.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
                            "proto", money("l_extendedprice").alias("amt")))


def dedup_before_filter(spark, sf):
    """D1 + P2: keep first per line key, then the alternative code list."""
    li = _lines_with_proto(spark, sf)
    out = dedup_first(li, LINE_KEY, LINE_ORDER).where(F.col("proto").isin(*ALT_ALLOWED_CODES))
    return _line_rows(out)


def dedup_after_filter(spark, sf):
    """D2 + P2: filter on codes first, then keep first per line key."""
    li = _lines_with_proto(spark, sf)
    out = dedup_first(flt.filter_codes(li, "proto", ALT_ALLOWED_CODES), LINE_KEY, LINE_ORDER)
    return _line_rows(out)


def dedup_metric(spark, sf):
    """D3: rows, groups, duplicates removed (before the code filter), and
    rows kept after the filter."""
    li = _lines_with_proto(spark, sf)
    kept = dedup_first(li, LINE_KEY, LINE_ORDER).where(F.col("proto").isin(*ALT_ALLOWED_CODES))
    n_kept = kept.select(F.count(F.lit(1)).cast("bigint")).scalar()
    return duplicates_removed(li, LINE_KEY).withColumn("kept_after_filter", n_kept)


def dedup_sensitivity(spark, sf):
    """The same funnel under several dedup keys."""
    li = read(spark, sf, "lineitem").withColumn("ok", F.col("l_returnflag") != "N")
    variants = {
        "k1": (LINE_KEY, LINE_ORDER, None),
        "k2": (["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"], None),
        "filter_then_k1": (LINE_KEY, LINE_ORDER, F.col("ok")),
        # Key *expressions* — order, day of the date, amount bucket
        "k3_norm": ([F.col("l_orderkey"), F.to_date("l_shipdate"), F.floor(F.col("l_extendedprice") / 100)],
                    ["l_linenumber"] + LINE_ORDER, None),
    }
    return fun.dedup_sensitivity(li, variants, "ok")


def step_funnel(spark, sf):
    """Base → dedup → code filter → credit rows → withholding-adjusted rows."""
    li = _lines_with_proto(spark, sf)
    return fun.step_funnel(li, LINE_KEY, LINE_ORDER, F.col("proto").isin(*ALT_ALLOWED_CODES),
                           F.col("l_returnflag") == "A", F.col("proto").isin("EL", "2EL", "L"))


def class_delta_counts(spark, sf):
    """Class counts of both ledgers and their delta B − A."""
    return fun.class_delta_counts(register(spark, sf), portal(spark, sf), "cls", "cls",
                                  ["paper", "electronic"], b_minus_a=True)


def first_per_key(spark, sf):
    """First line per order by ship date, line number (NULLs last)."""
    li = read(spark, sf, "lineitem")
    out = dedup_first(li, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_extendedprice"])
    return finish(out.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
                             F.col("l_shipdate").alias("d"), money("l_extendedprice").alias("amt")))


# ------------------------------------------------------------ aggregates
def class_totals(spark, sf):
    """A1: rows and amount per protocol class (zero-filled)."""
    a = register(spark, sf)
    return finish(agg.class_totals(a, "pcls", "amt", classes=[PAPER, ELECTRONIC, SELF_INVOICE]))


def code_summary(spark, sf):
    """A2: one summary per class over the full code dimension: zero rows for
    absent codes, description, fixed order, total row (one aggregation)."""
    a = register(spark, sf).withColumn("cls", F.col("pcls"))
    out = agg.code_summary(a, code_dimension(spark), "proto", "amt", by="cls")
    return finish(out.withColumnRenamed("cls", "sheet"))


def _portal_ids(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    blank = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("nan"))
              .when(k % 4 == 2, F.lit(None).cast("string")).otherwise(F.lit("None")))
    sdi = F.when(F.col("o_orderstatus") == "P", blank).otherwise(k.cast("string"))
    return o.withColumn("sdi", sdi)


def simple_total(spark, sf):
    """A4 + P8: portal rows split by empty id (tokens rule), count and sum."""
    o = flt.with_empty_flag(_portal_ids(spark, sf), "sdi", "tokens")
    return finish(agg.simple_total(o, money("o_totalprice"), "is_empty"))


def detail_totals(spark, sf):
    """A5 + P9: the first 5000 portal rows by (date, key) and a TOTALE row;
    amounts as text, totals by plain coercion (Italian text is ignored)."""
    o = read(spark, sf, "orders")
    t = _money_texts(F.col("o_totalprice"))
    txt = F.when(F.col("o_orderstatus") == "O", t["comma"]).otherwise(t["plain"])
    d = o.select(F.col("o_orderkey").alias("k"), F.lit("").alias("label"),
                 F.col("o_orderdate").alias("d"), txt.alias("amount_text"))
    d = flt.cap_rows(d, 5000, ["d", "k"])
    d = d.withColumn("amount", parse_number_plain("amount_text").cast("decimal(18,2)"))
    return finish(agg.detail_with_totals(d, ["amount"], "label"))


def code_distribution(spark, sf):
    """Raw rows per protocol code (before dedup and filter)."""
    return agg.code_distribution(_lines_with_proto(spark, sf), "proto")


def code_distribution_split(spark, sf):
    """Rows per code within each sign split, and the top 3 codes."""
    li = _lines_with_proto(spark, sf).withColumn("credit", F.col("l_returnflag") == "A")
    per = agg.code_distribution(li, "proto", "credit").withColumn("top_rank", F.lit(0))
    from pyspark.sql import Window
    top = agg.code_distribution(li, "proto", top=3)
    top = top.withColumn("credit", F.lit(None).cast("boolean")) \
             .withColumn("top_rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "code")))
    return per.unionByName(top)


def _tax_frame(spark, sf):
    a = register(spark, sf)
    return a.withColumn("tax_code", F.when(F.col("tax_rate") < 0.02, "I9").otherwise("XX")) \
            .withColumn("scls", F.when(F.col("pcls") == SELF_INVOICE, ELECTRONIC).otherwise(F.col("pcls")))


def taxcode_net(spark, sf):
    """Total, I9 withholding, net and I9 count, per class and overall."""
    a = _tax_frame(spark, sf)
    i9 = F.col("tax_code") == "I9"
    spec = {"total": (None, "amt"), "i9_withholding": (i9, "w"), "i9_rows": (i9, 1)}
    out = fun.with_overall(a, "scls", lambda df, g: agg.conditional_sums(df, spec, g))
    return finish(out.withColumn("net", F.col("total") - F.col("i9_withholding")))


def sign_split(spark, sf):
    """Unsigned amounts split by sign: positive, negative, net."""
    a = register(spark, sf)
    credit = F.col("rf") == "A"
    spec = {"positive": (~credit, "price"), "negative": (credit, "price"),
            "n_positive": (~credit, 1), "n_negative": (credit, 1)}
    out = fun.with_overall(a, "cls", lambda df, g: agg.conditional_sums(df, spec, g))
    return finish(out.withColumn("net", F.col("positive") - F.col("negative")))


def withholding_net(spark, sf):
    """A10: base − withholding of EL/2EL codes = net."""
    a = register(spark, sf)
    spec = {"base": (None, "amt"), "withholding": (F.col("proto").isin("EL", "2EL"), "w")}
    out = agg.conditional_sums(a, spec)
    return finish(out.withColumn("net", F.col("base") - F.col("withholding")))


def class_amounts(spark, sf):
    """Several amount columns per class (self-invoices apart)."""
    a = register(spark, sf)
    spec = {"rows": (None, 1), "amount": (None, "amt"), "price": (None, "price"), "withholding": (None, "w")}
    return finish(agg.conditional_sums(a, spec, ["pcls"]))


def key_months(spark, sf):
    """Sorted distinct months per order key, their count, first date."""
    a = register(spark, sf)
    return finish(agg.months_per_key(a, "k", "d"))


# --------------------------------------------------------- reconciliation
def compare_summary(spark, sf):
    """Paper / electronic / total, both sides and A − B."""
    return finish(rec.compare_summary(register(spark, sf), portal(spark, sf)))


def reconcile_rows_or_amount(spark, sf):
    """J2 (SURVEY §7.2): register lines vs orders by order key."""
    return finish(rec.reconcile_sums(register(spark, sf), portal(spark, sf), "k", "k", empty_id_rule=None))


def reconcile_amount(spark, sf):
    """Only A, only B, or amounts differing by more than 0.01."""
    return finish(rec.reconcile_amounts(register(spark, sf), portal(spark, sf), "k", "k", empty_id_rule=None))


def _electronic_ids(spark, sf):
    a = register(spark, sf).where(F.col("cls") == "electronic")
    a = a.withColumn("id", normalize_id(F.when(F.col("pk") % 10 == 0, F.lit("")).otherwise(
        F.concat(F.col("k").cast("string"), F.lit(".0")))))
    b = portal(spark, sf).where(F.col("cls") == "electronic").withColumn("id", normalize_id(F.col("k")))
    return a, b


def reconcile_electronic(spark, sf):
    """J2 in full: text ids (normalised), empty-id A rows as one row, total."""
    a, b = _electronic_ids(spark, sf)
    return finish(rec.reconcile_sums(a, b, "id", "id", empty_id_rule="strict", with_total=True))


def multiset_diff(spark, sf):
    """Surplus rows per (month, bucket) key, first rows by (date, key).

    Every register line against every order; the key makes surpluses on both
    sides (customers of an order play the quantity), and is NULL for every
    31st order.
    """
    key = lambda c: F.when(F.col("k") % 31 != 0, c.cast("bigint")).alias("bucket")
    a = register(spark, sf)
    a = a.select((F.year("d") * 100 + F.month("d")).cast("bigint").alias("ym"), key(F.col("q")), "k", "ln", "d", "amt")
    b = portal(spark, sf)
    b = b.select((F.year("d") * 100 + F.month("d")).cast("bigint").alias("ym"), key(F.col("cu") % 50 + 1), "k", "d", "amt")
    out = rec.multiset_diff(a, b, ["ym", "bucket"], ["d", "k", "ln"], ["d", "k"])
    return finish(out.select("outcome", "ym", "bucket", "k", "delta"))


def top_delta_detail(spark, sf):
    """30 keys by |Δ|, ≤20 rows per side each."""
    a, b = register(spark, sf), portal(spark, sf)
    out = rec.top_delta_detail(a, b, "k", a_order=["d", "ln"], b_order=["d"], top_n=30, per_side=20,
                               cols=["d"])
    return finish(out)


def unmatched_both_ways(spark, sf):
    """B-only keys, A-only keys (first row each), empty-id A rows.
    Both sides have ids that are blank or NULL; every 7th order has an id of its own,
    which the register doesn't know."""
    blank = F.when(F.col("k") % 2 == 0, F.lit(" "))
    a = register(spark, sf).withColumn("id", F.when(F.col("pk") % 10 == 0, blank).otherwise(F.col("k").cast("string")))
    b = portal(spark, sf).withColumn("id", F.when(F.col("k") % 11 == 0, blank).when(F.col("k") % 7 == 0, F.concat(F.lit("x"), "k"))
                                     .otherwise(F.col("k").cast("string")))
    out = rec.unmatched(a.select("id", "k", "ln", "d", "amt"), b.select("id", "k", "d", "amt"), "id",
                        a_order=["d", "ln"], b_order=["d"])
    return finish(out.select("section", "id", "k", "ln", "d", "amt"))


def one_to_one_diff(spark, sf):
    """Keys once on both sides whose amounts differ."""
    return finish(rec.one_to_one(register(spark, sf), portal(spark, sf), "k"))


def arrival_lookup(spark, sf):
    """B ids missing from the credit register, looked up in the whole
    register: months, first/last month, first date. Two orders share an id
    (the first by date and key is listed), and some ids are blank."""
    ident = F.when(F.col("k") % 25 == 0, F.lit(" ")).otherwise(F.floor(F.col("k") / 2).cast("string"))
    a, b = register(spark, sf).withColumn("id", ident), portal(spark, sf).withColumn("id", ident)
    out = rec.arrival_lookup(b, a.where(F.col("rf") == "A"), a, "id", "d", b_order=["d", "k"])
    return finish(out.select("id", "k", "amt", "n_months", "m0", "m1", "months", "first_reg"))


def unmatched_composite(spark, sf):
    """Paper B rows without a paper A row on (name, number, month; the
    month is NULL for every 3rd order); electronic B ids without an electronic A id; count + first 2 by key."""
    a, b = register(spark, sf), portal(spark, sf)
    ym = lambda: F.when(F.col("k") % 3 != 0, F.year("d") * 100 + F.month("d"))
    ap = a.where(F.col("cls") == "paper").select((F.col("ln") % 3).alias("nm"), "k", ym().alias("ym"))
    bp = b.where(F.col("cls") == "paper").select((F.col("cu") % 3).alias("nm"), "k", ym().alias("ym"))
    paper = rec.unmatched_by_columns(bp, ap, ["nm", "k", "ym"], ["k"], sample=2)
    ae = a.where(F.col("cls") == "electronic").select("k")
    be = b.where(F.col("cls") == "electronic").select("k")
    elec = rec.unmatched_by_columns(be, ae, ["k"], ["k"], sample=2)
    return (paper.select(F.lit("paper").alias("section"), "rank", "k", "n_unmatched")
            .unionByName(elec.select(F.lit("electronic").alias("section"), "rank", "k", "n_unmatched")))


def delta_by_sum_class(spark, sf):
    """Keys classified by non-zero sums; top 10 shared by |Δ|."""
    a, b = _electronic_ids(spark, sf)
    return finish(rec.delta_by_sum_class(a, b, "id"))


def mismatch_reasons(spark, sf):
    """Reasons for the surplus B rows, over the whole register and all
    orders. Number = order, date = year (NULL for every 13th order), name = line or
    customer class, amount = its number of digits; paper on side A are credits of a low tax rate."""
    a, b = register(spark, sf), portal(spark, sf)
    dt = F.when(F.col("k") % 13 != 0, F.year("d")).alias("dt")
    digits = F.length(F.floor(F.abs("amt")).cast("string")).alias("am")
    xa = a.select(F.col("k").alias("num"), dt, (F.col("ln") % 3).alias("nm"), digits,
                  ((F.col("rf") == "A") & (F.col("tax_rate") < 0.025)).alias("is_paper"))
    xb = b.select("k", F.col("k").alias("num"), dt, (F.col("cu") % 3).alias("nm"), digits)
    return rec.classify_mismatch(xa, xb, "num", "dt", "nm", "am", "is_paper", ["k"])


# ------------------------------------------------------------ end to end
# The driver tables rendered as the raw text exports the jobs read: loosely
# named headers, Italian number formats, month-first dates, blank ids.
def _register_export(spark, sf, order=()):
    """``order``: the lines are sorted before their texts are made, so that numbers are shuffled."""
    li = read(spark, sf, "lineitem")
    li = li.orderBy(*order) if order else li
    t = _money_texts(F.col("l_extendedprice"))
    w = withholding()
    return li.select(
        F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("Ragione Sociale"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("FAT_DATDOC"),
        F.col("l_orderkey").cast("string").alias("N. Fatture"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("DATA_REG_FATTURA"),
        F.concat(F.lit(" "), F.lower(protocol())).alias("FT_PROT"),
        F.when(F.col("l_returnflag") == "A", "A").otherwise("D").alias("FT_SEGNO"),
        F.col("l_linenumber").cast("string").alias("N_PROTOCOLLO"),
        t["it"].alias("IMPONIBILE"),
        F.lit("0").alias("IMP_TOT_IVA"),
        F.replace(w.cast("string"), F.lit("."), F.lit(",")).alias("IMP_TOT_RIT"),
        F.when(F.col("l_partkey") % 10 == 0, F.lit("")).otherwise(F.col("l_orderkey").cast("string"))
        .alias("IDENT_SDI"),
        # explicit "first row" order (the tables carry no file order)
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


_EXPORT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _portal_export(spark, sf, received: bool = False):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    blank = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("nan"))
              .when(k % 4 == 2, F.lit(None).cast("string")).otherwise(F.lit("None")))
    sdi = (F.when(F.col("o_orderstatus") == "P", blank)
            .when((F.col("o_orderstatus") == "F") & (k % 10 == 0), F.lit("0"))
            .otherwise(k.cast("string")))
    price = money("o_totalprice")
    paid = to_money(price * F.lit("0.90").cast("decimal(18,2)"))
    t_total, t_paid = _money_texts(F.col("o_totalprice")), _money_texts(paid)
    if received:
        vat = to_money(price * F.lit("0.10").cast("decimal(18,2)"))
        return o.select(
            F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("Creditore"),
            k.cast("string").alias("Numero fattura"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("Data emissione"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("Data documento"),
            F.date_format("o_orderdate", "MM/dd/yyyy").alias("Data pagamento"),
            F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.lit("n/d"))
            .otherwise(F.replace(vat.cast("string"), F.lit("."), F.lit(","))).alias("IVA"),
            F.when(F.col("o_orderstatus") == "F", t_total["plain"]).otherwise(t_total["comma"])
            .alias("Importo fattura"),
            sdi.alias("Identificativo SDI"))
    return o.select(
        sdi.alias("Identificativo SDI"),
        k.cast("string").alias("C"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("F"),
        F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("Ragione Sociale"),
        t_total["it"].alias("Importo fattura"),
        t_paid["it"].alias("Importo pagato"),
    )


def register_report(spark, sf):
    """Register export → cleaned ledger statistics."""
    from tallyspark.plans.jobs import register_report as job
    out = job(_register_export(spark, sf), check_nonempty=False, order=_EXPORT_ORDER)
    return finish(out["stats"])


def register_code_sheets(spark, sf):
    """The three per-class code summaries of the register report."""
    from tallyspark.plans.jobs import register_report as job
    out = job(_register_export(spark, sf), check_nonempty=False, order=_EXPORT_ORDER)
    return finish(out["summary"].withColumnRenamed("cls", "sheet"))


def portal_paid_report(spark, sf):
    """Portal paid export → split statistics (paid amount used)."""
    from tallyspark.plans.jobs import portal_paid_report as job
    return finish(job(_portal_export(spark, sf))["stats"])


def register_detail(spark, sf):
    """The register's detail table."""
    from tallyspark.plans.jobs import register_report as job
    out = job(_register_export(spark, sf), check_nonempty=False, order=_EXPORT_ORDER)["data"]
    return finish(out.select("party", "doc_date", "doc_no", "reg_date", "code", "sign", "seq_no", "ext_id", "cls",
                             "amount", "tax", "order_total", "withholding"))


def register_code_counts(spark, sf):
    """A3/K3: rows of the register per allowed code."""
    from tallyspark.plans.jobs import register_report as job
    return finish(job(_register_export(spark, sf), check_nonempty=False, order=_EXPORT_ORDER)["code_counts"])


def portal_received_detail(spark, sf):
    """The received invoices' detail table with its total row; VAT is
    blank or no number for some orders (then 0)."""
    from tallyspark.plans.jobs import portal_received_report as job
    out = job(_portal_export(spark, sf, received=True), RECEIVED_FILE)["data"]
    return finish(out.select(F.col("Ragione sociale").alias("party"), F.col("`N.fatture`").alias("doc_no"),
                             F.col("Data pagamento").alias("paid"), F.col("Ivam").alias("vat"),
                             F.col("Imponibile").alias("taxable"), F.col("Totale fatture").alias("total")))


def _compared(spark, sf, table):
    from tallyspark.plans.jobs import compare_ledgers
    return compare_ledgers(_register_export(spark, sf), _portal_export(spark, sf), order=_EXPORT_ORDER)[table]


def compare_paper_detail(spark, sf):
    """The paper detail (J4 on number and amount)."""
    return finish(_compared(spark, sf, "paper_detail").select("outcome", "num_key", "amount_key", "delta"))


def compare_delta(spark, sf):
    """Electronic ids whose amounts differ or that one side lacks."""
    return finish(_compared(spark, sf, "delta"))


def compare_drilldown(spark, sf):
    """Rows of the 30 ids with the largest difference."""
    return finish(_compared(spark, sf, "drilldown").select("k", "side", "amt", "doc_no"))


def compare_overview(spark, sf):
    """Counts and amounts of both sides by class, in one row."""
    out = _compared(spark, sf, "overview")
    parts = [F.col(f"{side}_{c}")[f].alias(f"{side}_{c}_{f}") for side in "ab" for c in (PAPER, ELECTRONIC) for f in ("count", "amount")]
    return finish(out.select("period", *parts))


RECEIVED_FILE = "Portale Ricevute 2 TRIM 2000.xlsx"


def portal_received_report(spark, sf):
    """Received export, quarter of the file name on payment date."""
    from tallyspark.plans.jobs import portal_received_report as job
    return finish(job(_portal_export(spark, sf, received=True), RECEIVED_FILE)["stats"])


def compare_report(spark, sf):
    """Register export vs portal export → comparison summary."""
    from tallyspark.plans.jobs import compare_ledgers
    out = compare_ledgers(_register_export(spark, sf), _portal_export(spark, sf), order=_EXPORT_ORDER)
    return finish(out["summary"])


def compare_report_electronic(spark, sf):
    """The electronic detail sheet (J2 with empty-id row and total)."""
    from tallyspark.plans.jobs import compare_ledgers
    out = compare_ledgers(_register_export(spark, sf), _portal_export(spark, sf), order=_EXPORT_ORDER)
    return finish(out["electronic_detail"])


def csv_roundtrip(spark, sf):
    """The portal written as a Latin-1, ';'-separated export with
    Italian amounts and day-first dates (in the shared scratch folder), read
    back by the sniffing CSV reader and parsed."""
    import uuid

    from tallyspark.session import checkpoint_dir
    from tallyspark.sources import read_delimited
    o = read(spark, sf, "orders")
    t = _money_texts(F.col("o_totalprice"))
    export = o.select(F.col("o_orderkey").cast("string").alias("Numero fattura"),
                      F.concat(F.lit("Città "), F.col("o_custkey").cast("string")).alias("Creditore"),
                      t["it"].alias("Importo fattura"),
                      F.date_format("o_orderdate", "dd/MM/yyyy").alias("Data emissione"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv_roundtrip/{uuid.uuid4().hex}"
    export.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    df = read_delimited(spark, path)
    return finish(df.select(F.col("Numero fattura").cast("bigint").alias("k"), "Creditore",
                            parse_number_mixed("Importo fattura").alias("amount"),
                            date_text(parse_date("Data emissione")).alias("d")))


def _written(df: DataFrame, folder: str, name: str, **options) -> None:
    """``df`` as CSV files ``<name>.<part>.csv`` in a folder (the parts in the order of their names)."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    df.write.options(header=True, **options).csv(f"{folder}/_{name.replace(' ', '_')}")
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(path(f"{folder}/_{name.replace(' ', '_')}/part-*")):
        part = found.getPath().getName().split("-")[1]
        fs.rename(found.getPath(), path(folder, f"{name}.{part}.csv"))


def _scratch(spark, name: str) -> str:
    import uuid

    from tallyspark.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


#: One column whose name is a header line and whose values are lines: written as they are.
_AS_THEY_ARE = {"sep": "\u0001", "quote": "\u0002", "escape": "\u0002"}


def csv_quoted_lines(spark, sf):
    """Names with line ends, delimiters and quotes in quoted fields, written by
    many tasks and read back."""
    from tallyspark.sources import read_delimited
    o = read(spark, sf, "orders")
    k, name = F.col("o_orderkey"), F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string"))
    names = (F.when(k % 5 == 0, F.concat(name, F.lit('\n"Sons", Ltd\n'), k.cast("string")))
              .when(k % 5 == 1, F.concat(F.lit('5" pipe, '), name)).otherwise(name))
    export = o.select(k.cast("string").alias("Numero fattura"), names.alias("Creditore"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Importo fattura"))
    path = _scratch(spark, "csv_quoted_lines")
    _written(export.repartition(3, "Numero fattura"), path, "export", escape='"')
    df = read_delimited(spark, path)
    return finish(df.select(F.col("Numero fattura").cast("bigint").alias("k"), "Creditore", parse_number_mixed("Importo fattura").alias("amount")))


def register_from_files(spark, sf):
    """S2/S4/M2–M6/M10/M11/D3/K3 on E1: the register in one folder of exports of two
    kinds: odd lines under loose names, ";" and Italian amounts, some with too many
    fields; even lines under lower-case names, ",", with another document number that gives way and no protocol number. "First" is the order of the files."""
    from tallyspark.plans.jobs import register_report as job
    from tallyspark.plans.layout import REGISTER
    from tallyspark.sources import read_exports
    e = _register_export(spark, sf, _EXPORT_ORDER)
    plain = F.replace(F.replace(F.col("IMPONIBILE"), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    odd_header = "Ragione Sociale;FAT_DATDOC;N. Fatture;DATA_REG_FATTURA;FT_PROT;FT_SEGNO;N_PROTOCOLLO;IMPONIBILE;IMP_TOT_IVA;IMP_TOT_RIT;IDENT_SDI"
    odd = F.concat_ws(";", *[F.col(f"`{c}`") for c in odd_header.split(";")])
    odd = F.when((F.col("`N. Fatture`").cast("bigint") % 50 == 0) & (F.col("l_linenumber") == 1), F.concat(odd, F.lit(";5\" x;y"))).otherwise(odd)
    even_header = "c_nome,fat_datdoc,n_fatture,n_documento,fat_datreg,fat_prot,ft_segno,imponibile,fat_totiva,ra_imposta,tmc_g8"
    even = F.concat_ws(",", "`Ragione Sociale`", "FAT_DATDOC", F.concat(F.lit("X"), F.col("`N. Fatture`")), "`N. Fatture`", "DATA_REG_FATTURA", F.trim("FT_PROT"),
                       "FT_SEGNO", plain, "IMP_TOT_IVA", F.replace("IMP_TOT_RIT", F.lit(","), F.lit(".")), "IDENT_SDI")
    path = _scratch(spark, "register_from_files")
    _written(e.where(F.col("l_linenumber") % 2 == 1).select(odd.alias(odd_header)), path, "a register", **_AS_THEY_ARE)
    _written(e.where(F.col("l_linenumber") % 2 == 0).select(even.alias(even_header)), path, "b register", **_AS_THEY_ARE)
    raw = read_exports(spark, f"{path}/*.csv", REGISTER, keep_bad=True)
    return finish(job(raw, check_nonempty=False)["stats"])


def portal_periods_by_file(spark, sf):
    """F18/P3 by file, M8: orders dealt to the exports of three quarters; each row counts in the quarter
    that its file is named after, and files outside the period asked for aren't read."""
    import datetime as dt

    from tallyspark.plans.layout import PORTAL_PAID
    from tallyspark.sources import read_exports
    o = _portal_export(spark, sf).withColumn("k", F.col("C").cast("bigint"))
    path = _scratch(spark, "portal_periods_by_file")
    for i, name in enumerate(("Portale I TRIM 2000", "Portale 2° trimestre 2000", "Portale III TRIM. 2000")):
        _written(o.where(F.col("k") % 3 == i).drop("k"), path, name, sep=";")
    raw = read_exports(spark, f"{path}/*.csv", PORTAL_PAID, ["Importo pagato"], period=(dt.date(2000, 4, 1), dt.date(2000, 9, 30)))
    out = flt.filter_file_period(raw.withColumn("d", parse_date("Data emissione")), "d")
    return finish(out.select(F.col("Numero fattura").cast("bigint").alias("k"), "d", parse_number_mixed("Importo pagato").alias("paid"),
                             F.substring_index("_src", ".", 1).alias("file")))


def period_if_filled(spark, sf):
    """P6 "both in turn": a period on the order date, then a second period
    on the paid date, applied because some paid dates are filled (status F:
    order date + 3 days; other rows blank and so dropped)."""
    import datetime as dt
    o = read(spark, sf, "orders")
    o = flt.filter_date_range(o, "o_orderdate", dt.date(1997, 1, 1), dt.date(1997, 12, 31))
    o = o.withColumn("paid_text", F.when(F.col("o_orderstatus") == "F",
                                         F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd"))
                     .otherwise(F.lit("")))
    o = o.withColumn("paid_date", parse_date("paid_text"))
    out = flt.filter_period_if_filled(o, "paid_date", (dt.date(1997, 1, 1), dt.date(1997, 6, 30)), "paid_text")
    return finish(out.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"),
                             F.col("paid_date").alias("paid")))
