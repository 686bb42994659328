"""Dedup, filters, aggregates and reconciliation on small fixtures
(G1, G2, G10–G13) and the invariants between result tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import code_dimension
from tallyspark.operators import aggregates as agg
from tallyspark.operators import filters as flt
from tallyspark.operators import reconcile as rec
from tallyspark.operators import funnels
from tallyspark.operators.dedup import dedup_first, dedup_first_counted, duplicates_removed


def test_dedup_order_g1(spark):
    df = spark.createDataFrame([(1, "k", "XX"), (2, "k", "EP")], "row int, key string, code string")
    ok = F.col("code").isin("EP")
    assert dedup_first(df, ["key"], ["row"]).where(ok).count() == 0
    assert [r.row for r in dedup_first(df.where(ok), ["key"], ["row"]).collect()] == [2]


def test_dedup_null_keys_g2(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "row int, id string")
    assert sorted(r.row for r in dedup_first(df, ["id"], ["row"]).collect()) == [1, 3]
    m = duplicates_removed(df, ["id"]).first()
    assert (m.rows, m.groups, m.duplicates_removed) == (3, 2, 1)


def test_dedup_plan_limits_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    plan = dedup_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_period_filters(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2026, 3, 31),), (dt.datetime(2026, 4, 5),), (None,)], "d timestamp_ntz")
    q = (dt.date(2026, 1, 1), dt.date(2026, 3, 31))
    assert flt.filter_period(df, "d", q).count() == 1
    assert flt.filter_period_extended(df, "d", q).count() == 2
    assert flt.filter_period(df, "d", None).count() == 3
    assert flt.filter_period(df, "missing", q).count() == 3


def test_code_summary_zero_rows(spark):
    df = spark.createDataFrame([("P", Decimal("10.00")), ("P", Decimal("5.00"))], "code string, amt decimal(18,2)")
    dim = code_dimension(spark).where(F.col("cls") == "paper")
    rows = {r.code: (r.n, r.amount) for r in agg.code_summary(df, dim, "code", "amt").collect()}
    assert rows["P"] == (2, Decimal("15.00")) and rows["2P"] == (0, Decimal("0.00"))
    assert rows["TOTAL"] == (2, Decimal("15.00")) and len(rows) == 8


def _sides(spark, a_rows, b_rows):
    a = spark.createDataFrame(a_rows, "k string, amt decimal(18,2), d int")
    b = spark.createDataFrame(b_rows, "k string, amt decimal(18,2), d int")
    return a, b


def test_multiset_first_rows_g10(spark):
    a, b = _sides(spark, [("x", Decimal(1), 3), ("x", Decimal(1), 1), ("x", Decimal(1), 2)], [("x", Decimal(1), 9)])
    out = rec.multiset_diff(a, b, ["k", "amt"], ["d"], ["d"])
    assert sorted(r.d for r in out.collect()) == [1, 2]


def test_rows_vs_amount_g11_g12_g13(spark):
    a, b = _sides(spark, [("i1", Decimal(60), 1), ("i1", Decimal(40), 2), ("i2", Decimal(50), 1),
                          ("i2", Decimal(-50), 2), ("", Decimal(30), 1)],
                  [("i1", Decimal(100), 1)])
    j2 = {r.k: r.outcome for r in rec.reconcile_sums(a, b, "k", "k").collect()}
    assert j2 == {"i1": "both_differ", "i2": "only_a", "": "only_a_empty_id"}
    j3 = {r.k: r.outcome for r in rec.reconcile_amounts(a, b, "k", "k").collect()}
    assert j3 == {"i2": "only_a"}
    j10 = rec.delta_by_sum_class(a, b, "k").collect()
    secs = {r.section: r.n_keys for r in j10 if r.section != "top_shared"}
    assert secs == {"only_a": 1, "both": 1}  # i2 nets to 0: in no class; "" is only_a
    tot = [r for r in rec.reconcile_sums(a, b, "k", "k", with_total=True).collect() if r.outcome == "total"][0]
    assert (tot.delta_rows, tot.delta_sum) == (4, Decimal("30.00"))


def test_compare_summary_zero_fill(spark):
    a, b = _sides(spark, [("x", Decimal(5), 1)], [])
    a = a.withColumn("cls", F.lit("paper"))
    b = b.withColumn("cls", F.lit("paper"))
    rows = {r.category: (r.a_n, r.b_n, r.delta_amt) for r in rec.compare_summary(a, b).collect()}
    assert rows == {"paper": (1, 0, Decimal("5.00")), "electronic": (0, 0, Decimal("0.00")),
                    "total": (1, 0, Decimal("5.00"))}


def test_top_delta_detail_caps(spark):
    a = spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") * 1.0).cast("decimal(18,2)").alias("amt"),
                               F.col("id").alias("d"))
    a = a.unionByName(a).unionByName(a)
    b = a.limit(0)
    out = rec.top_delta_detail(a, b, "k", a_order=["d"], b_order=["d"], top_n=5, per_side=2, cols=["d"])
    rows = out.collect()
    assert len({r.k for r in rows}) == 5 and len(rows) == 10
    assert {r.k for r in rows} == {"49", "48", "47", "46", "45"}


def test_one_to_one_and_unmatched(spark):
    a, b = _sides(spark, [("a", Decimal(10), 1), ("b", Decimal(5), 1), ("b", Decimal(5), 2), ("", Decimal(1), 1)],
                  [("a", Decimal(12), 1), ("c", Decimal(3), 1)])
    assert [(r.k, r.delta) for r in rec.one_to_one(a, b, "k").collect()] == [("a", Decimal("-2.00"))]
    secs = sorted((r.section, r.k) for r in rec.unmatched(a, b, "k", ["d"], ["d"]).collect())
    assert secs == [("only_a", "b"), ("only_a_empty_id", ""), ("only_b", "c")]


def test_arrival_lookup(spark):
    import datetime as dt
    a = spark.createDataFrame([("x", dt.datetime(2025, 1, 3)), ("x", dt.datetime(2025, 3, 1)),
                               ("x", dt.datetime(2025, 1, 9))], "k string, d timestamp_ntz")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    out = {r.k: (r.months, r.n_months) for r in rec.arrival_lookup(b, a.limit(0), a, "k", "d").collect()}
    assert out == {"x": ("2025-01, 2025-03", 2), "y": ("", 0)}


def test_hot_key_ranking_matches_window(spark):
    """A key holding most rows: the partition-spread ranking gives exactly
    the rows the plain window gives."""
    a = spark.range(3000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("k"),
                                 F.lit(Decimal(1)).cast("decimal(18,2)").alias("amt"),
                                 ((F.col("id") * 7919) % 3000).alias("d"))
    b = a.where(F.col("d") % 3 == 0)
    spread = rec.multiset_diff(a, b, ["k"], ["d"], ["d"])
    from pyspark.sql import Window
    n_a, n_b = (df.groupBy("k").agg(F.count("*").alias(n)) for df, n in ((a, "na"), (b, "nb")))
    plain = (a.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("d"))).join(n_a, "k").join(n_b, "k", "left")
              .where(F.col("rn") <= F.col("na") - F.coalesce("nb", F.lit(0))))
    assert sorted((r.k, r.d) for r in plain.collect()) == sorted((r.k, r.d) for r in spread.collect())
    assert sum(1 for r in spread.collect() if r.k == "hot") == 2400 - 800


def test_null_keys_and_repeated_ids(spark):
    a = spark.createDataFrame([(None, 1, 5), (None, 2, 5), ("x", 3, None)], "k string, d int, m int")
    b = spark.createDataFrame([(None, 9, 5), ("x", 8, None), ("x", 7, None), ("y", 6, None)], "k string, d int, m int")
    out = rec.multiset_diff(a, b, ["k", "m"], ["d"], ["d"], None, None)
    assert sorted((r.outcome, r.k or "", r.d) for r in out.collect()) == [("only_a", "", 1), ("only_b", "x", 7), ("only_b", "y", 6)]
    import datetime as dt
    a = spark.createDataFrame([("z", dt.datetime(2025, 1, 3))], "k string, d timestamp_ntz")
    b = spark.createDataFrame([("x", 2), ("x", 1), ("", 3), (None, 4), ("z", 5)], "k string, v int")
    got = rec.arrival_lookup(b, a, a, "k", "d", b_order=["v"]).collect()
    assert [(r.k, r.v) for r in got] == [("x", 1)]


def test_count_codes_a3(spark):
    df = spark.createDataFrame([("EP",), ("EP",), ("EL",)], "code string")
    assert {r.code: r.n for r in agg.count_codes(df, "code", ["EP", "EL", "EZ"]).collect()} == {"EP": 2, "EL": 1, "EZ": 0}


def test_layout_helpers_m12_m13(spark):
    from tallyspark.plans.layout import normalize_name, project
    assert normalize_name(" n. Fatture ") == "NFATTURE"
    df = spark.createDataFrame([("a", "b")], "C_NOME string, FAT_PROT string")
    assert project(df, {"FAT_PROT": "Protocollo", "C_NOME": "Ragione Sociale"}).columns == ["Protocollo", "Ragione Sociale"]


def test_period_if_filled_p6(spark):
    import datetime as dt
    q = (dt.date(2026, 1, 1), dt.date(2026, 3, 31))
    rows = [(dt.datetime(2026, 2, 1), "2026-02-01"), (dt.datetime(2026, 5, 1), "2026-05-01")]
    df = spark.createDataFrame(rows, "d timestamp_ntz, t string")
    assert flt.filter_period_if_filled(df, "d", q, "t").count() == 1
    blank = spark.createDataFrame([(r[0], " ") for r in rows], "d timestamp_ntz, t string")
    assert flt.filter_period_if_filled(blank, "d", q, "t").count() == 2


def test_first_and_count_in_one_pass(spark):
    df = spark.createDataFrame([(None, 3, "c"), (None, 1, "a"), ("k", None, "x"), ("k", 5, "y"), ("k", 6, "z"), ("m", None, None)], "k string, o int, v string")
    got = {r.k: (r.o, r.v, r._copies) for r in dedup_first_counted(df, ["k"], ["o", "v"]).collect()}
    assert got == {None: (1, "a", 2), "k": (5, "y", 3), "m": (None, None, 1)}  # NULLs last, NULL keys one key
    same = dedup_first(df, ["k"], ["o", "v"]).collect()
    assert {r.k: (r.o, r.v) for r in same} == {k: v[:2] for k, v in got.items()}


def test_unmatched_empty_ids_and_null_parts(spark):
    """Empty ids of either side match nothing, B's are left out; J9: NULL equals NULL."""
    a = spark.createDataFrame([("1", 2, "a2"), ("1", 1, "a1"), ("2", 1, "both"), (" ", 1, "e1"), (None, 2, "e2"), (None, 3, "e3")], "id string, o int, v string")
    b = spark.createDataFrame([("2", 1, "b"), ("3", None, "late"), ("3", 9, "first"), ("", 1, "x"), (None, 1, "y")], "id string, o int, w string")
    got = rec.unmatched(a, b, "id", ["o"], ["o"])
    assert got.columns == ["id", "o", "v", "w", "section"]
    assert sorted((r.section, r.id or "", r.v or r.w) for r in got.collect()) == [
        ("only_a", "1", "a1"), ("only_a_empty_id", "", "e2"), ("only_a_empty_id", "", "e3"), ("only_a_empty_id", " ", "e1"), ("only_b", "3", "first")]
    left = rec.unmatched_by_columns(b.select("id", "o"), a.select("id", "o"), ["id", "o"], ["id", "o"], sample=9).collect()
    assert [(r.id, r.o, r.n_unmatched) for r in left] == [("", 1, 4), ("3", 9, 4), ("3", None, 4), (None, 1, 4)]
    same = rec.unmatched_by_columns(a.select("id", "o"), a.select("id", "o"), ["id", "o"], ["id", "o"])
    assert same.count() == 0


def test_first_present_m12(spark):
    from tallyspark.plans.layout import MissingColumnsError, first_present
    df = spark.createDataFrame([("1", "2")], "`a.b` string, c string")
    assert df.select(first_present(df, ["x", "a.b", "c"])).first()[0] == "1"
    assert df.select(first_present(df, ["x"], "none")).first()[0] == "none"
    with pytest.raises(MissingColumnsError, match="x, y"):
        first_present(df, ["x", "y"])


def test_sensitivity_shuffles_each_row_once(spark):
    """Variants that share a key number their groups where one shuffle put the rows, with the results of the general way."""
    rows = [(k, s, ln, p, ok) for k in (1, 2, None) for s in ("a", "b", None) for ln in (1, 2, None) for p, ok in ((1.5, True), (2.5, False), (None, None))]
    df = spark.createDataFrame(rows, "k long, s string, ln int, p double, ok boolean")
    variants = {"v1": (["k", "ln"], ["s", "p"], None), "pre": (["k", "ln"], ["s", "p"], F.col("ok")),
                "v2": ([F.col("k"), F.floor("p"), "s"], ["ln"], None)}
    out = funnels.dedup_sensitivity(df, variants, "ok")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    assert out.collect() == funnels.sensitivity_by_variant(df, variants, "ok").collect()
    other = {"v1": (["k"], ["s", "ln", "p"], None), "v2": (["s"], ["k", "ln", "p"], None)}
    assert funnels.dedup_sensitivity(df, other, "ok").first().asDict()["v2"] == 3


def test_text_keys_are_sorted_by_their_hash(spark):
    df = spark.createDataFrame([("1996-01-01", "x", 2, "b"), ("1996-01-01", "x", 1, "a"), (None, "x", 1, "c"), (None, "x", 3, "d"), ("1996-01-01", None, 5, "e")],
                               "d string, n string, o int, v string")
    counted = dedup_first_counted(df, ["d", "n"], ["o"])
    first = dedup_first(df, ["d", "n"], ["o"])
    assert {(r.d, r.n, r.v, r._copies) for r in counted.collect()} == {("1996-01-01", "x", "a", 2), (None, "x", "c", 2), ("1996-01-01", None, "e", 1)}
    assert {r.v for r in first.collect()} == {"a", "c", "e"}
    assert all("xxhash64" in x._jdf.queryExecution().executedPlan().toString() for x in (counted, first))
