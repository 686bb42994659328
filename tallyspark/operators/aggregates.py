"""Aggregations.

All of them are hash aggregates with partial (map-side) aggregation, so a
hot class or code is combined inside each task before the shuffle. Sums are
taken on ``decimal`` money (exact) and only cast to double at the output
edge by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.common import as_col
from tallyspark.functions.dates import month_of
from tallyspark.functions.numbers import SUM_TYPE


def _zero_sum() -> Column:
    return F.lit(0).cast(SUM_TYPE)


def money_sum(c) -> Column:
    """Exact decimal sum, 0 for an empty group."""
    return F.coalesce(F.sum(as_col(c)).cast(SUM_TYPE), _zero_sum())


def class_totals(df: DataFrame, cls_col, amount_col, classes: Sequence[str] | None = None) -> DataFrame:
    """A1: ``(cls, n, amount)`` per class. With ``classes`` every listed class
    appears, zero-filled (conditional sums in one pass, one output row per
    class; no join needed)."""
    if classes is None:
        return (df.groupBy(as_col(cls_col).alias("cls"))
                  .agg(F.count(F.lit(1)).cast("bigint").alias("n"), money_sum(amount_col).alias("amount")))
    aggs = []
    for c in classes:
        hit = as_col(cls_col) == F.lit(c)
        aggs += [F.sum(F.when(hit, 1).otherwise(0)).cast("bigint").alias(f"n_{c}"),
                 F.coalesce(F.sum(F.when(hit, as_col(amount_col))), F.lit(0)).cast(SUM_TYPE).alias(f"amt_{c}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', n_{c}, amt_{c}" for c in classes)
    return wide.selectExpr(f"stack({len(classes)}, {stack}) as (cls, n, amount)")


def code_summary(df: DataFrame, dim: DataFrame, code_col, amount_col,
                 total_label: str = "TOTAL", total_pos: int = 99, by: str | None = None) -> DataFrame:
    """A2: per-code count and sum for every code of ``dim`` (pos, code,
    descr), zero rows for absent codes, plus a total row.

    With ``by`` (a column of both ``df`` and ``dim``, e.g. the class) every
    group of the dimension is its own summary with its own total — all
    groups from one aggregation of the fact side. The fact side is
    aggregated first (one row per code) and restricted to the dimension's
    codes, so the join is between two tiny relations.
    """
    keys = ([by] if by else []) + ["code"]
    g = (df.groupBy(*([F.col(by)] if by else []), as_col(code_col).alias("code"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(as_col(amount_col)).alias("s"))
           .join(dim.select(*keys), keys, "left_semi"))
    rows = (dim.join(g, keys, "left")
               .select(*([by] if by else []), F.col("pos").cast("bigint").alias("pos"), "code", "descr",
                       F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                       F.coalesce(F.col("s").cast(SUM_TYPE), _zero_sum()).alias("amount")))
    total_aggs = [F.lit(total_pos).cast("bigint").alias("pos"), F.lit(total_label).alias("code"),
                  F.lit("").alias("descr"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
                  money_sum("amount").alias("amount")]
    total = rows.groupBy(by).agg(*total_aggs) if by else rows.agg(*total_aggs)
    return rows.unionByName(total)


def count_codes(df: DataFrame, code_col, codes: Sequence[str]) -> DataFrame:
    """A3: rows per listed code (absent codes → 0)."""
    return class_totals(df.withColumn("_one", F.lit(0)), code_col, "_one", classes=list(codes)) \
        .select(F.col("cls").alias("code"), "n")


def simple_total(df: DataFrame, amount_col, group_col=None) -> DataFrame:
    """A4: count and sum, overall or per split flag."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n"), money_sum(amount_col).alias("amount")]
    return df.agg(*aggs) if group_col is None else df.groupBy(as_col(group_col)).agg(*aggs)


def detail_with_totals(detail: DataFrame, money_cols: Sequence[str], label_col: str,
                       label: str = "TOTALE") -> DataFrame:
    """A5: a detail table plus one totals row (sum of every money column;
    the label goes in ``label_col``; other columns NULL)."""
    sums = {c: F.sum(F.col(c)).alias(c) for c in money_cols}
    row = []
    for name, dtype in detail.dtypes:
        if name in sums:
            row.append(sums[name].cast(dtype).alias(name))
        elif name == label_col:
            row.append(F.lit(label).cast(dtype).alias(name))
        else:
            row.append(F.lit(None).cast(dtype).alias(name))
    return detail.unionByName(detail.agg(*row))


def code_distribution(df: DataFrame, code_col, split_col=None, top: int | None = None) -> DataFrame:
    """Rows per code (optionally per split), by code, or the ``top``
    codes by count (ties by code)."""
    keys = [as_col(code_col).alias("code")] + ([as_col(split_col)] if split_col is not None else [])
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    if top is None:
        return g
    return g.orderBy(F.col("n").desc(), F.col("code").asc_nulls_last()).limit(top)


def conditional_sums(df: DataFrame, spec: Mapping[str, tuple], group_cols: Sequence = ()) -> DataFrame:
    """Several ``sum(value) where condition`` in one pass.

    ``spec`` maps an output name to ``(condition or None, value)``; a value of
    ``1`` counts rows. Output money is exact decimal.
    """
    aggs = []
    for name, (cond, value) in spec.items():
        v = F.lit(1) if isinstance(value, int) else as_col(value)
        term = v if cond is None else F.when(cond, v)
        if isinstance(value, int):
            aggs.append(F.coalesce(F.sum(term), F.lit(0)).cast("bigint").alias(name))
        else:
            aggs.append(F.coalesce(F.sum(term), F.lit(0)).cast(SUM_TYPE).alias(name))
    return df.groupBy(*[as_col(g) for g in group_cols]).agg(*aggs) if group_cols else df.agg(*aggs)


def rows_and_sum_by_key(df: DataFrame, key, amount_col, prefix: str) -> DataFrame:
    """``(k, <prefix>_rows, <prefix>_sum)`` per key."""
    return (df.groupBy(as_col(key).alias("k"))
              .agg(F.count(F.lit(1)).cast("bigint").alias(f"{prefix}_rows"),
                   F.sum(as_col(amount_col)).cast(SUM_TYPE).alias(f"{prefix}_sum")))


def months_per_key(df: DataFrame, key, date_col) -> DataFrame:
    """Sorted distinct ``yyyy-MM`` months per key joined by ", ", the
    number of months, and the first date.

    Grouped twice: first by (key, month) so that a key with millions of rows
    is reduced to at most one row per month before any list is built; the
    list per key is then bounded by the number of distinct months.
    """
    km = (df.where(as_col(date_col).isNotNull())
            .groupBy(as_col(key).alias("k"), month_of(date_col).alias("month"))
            .agg(F.min(as_col(date_col)).alias("first_date")))
    return (km.groupBy("k")
              .agg(F.array_join(F.array_sort(F.collect_list("month")), ", ").alias("months"),
                   F.count(F.lit(1)).cast("bigint").alias("n_months"),
                   F.min("first_date").alias("first_date")))
