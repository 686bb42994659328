"""Invariants between the comparison's result tables, on the
driver tables rendered as exports, at the smallest scale factors."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import catalog as C
from tallyspark.plans.jobs import compare_ledgers


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_compare_invariants(spark, sf):
    if not os.path.exists(sf):
        pytest.skip("driver tables not present")
    out = compare_ledgers(C._register_export(spark, sf), C._portal_export(spark, sf), order=C._EXPORT_ORDER)
    summ = {r.category: r for r in out["summary"].collect()}
    # class rows add up to the total row
    for f in ("a_n", "b_n", "a_amt", "b_amt"):
        assert getattr(summ["paper"], f) + getattr(summ["electronic"], f) == getattr(summ["total"], f)
    # multiset difference of paper rows: matched pairs cancel exactly
    paper = out["paper_detail"].agg(F.sum("delta").alias("d"),
                                    F.sum(F.when(F.col("outcome") == "only_a", 1).otherwise(0)).alias("na"),
                                    F.sum(F.when(F.col("outcome") == "only_b", 1).otherwise(0)).alias("nb")).first()
    assert paper.d == summ["paper"].delta_amt
    assert paper.na - paper.nb == summ["paper"].delta_n
    # electronic detail total: rows exactly, amount within the unlisted residuals
    ed = [r for r in out["electronic_detail"].collect() if r.outcome == "total"][0]
    assert ed.delta_rows == summ["electronic"].delta_n
    a_keys = out["electronic_detail"].where(F.col("outcome") != "total").count()
    assert abs(ed.delta_sum - summ["electronic"].delta_amt) <= Decimal("0.01") * max(1, a_keys)
    # the amount-difference list never contains equal-sum keys
    assert out["delta"].where((F.col("outcome") == "different_amount")
                              & (F.abs("delta_sum") <= Decimal("0.01"))).count() == 0
    # drill-down: at most 30 keys, at most 20 rows per side and key
    dd = out["drilldown"].groupBy("k", "side").count().collect()
    assert len({r.k for r in dd}) <= 30 and all(r["count"] <= 20 for r in dd)
