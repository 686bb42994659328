"""Audit funnels: how many rows survive each step.

Counts are conditional sums over one scan; a per-step ``count()`` action
would re-read the input once per step and pull results through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.common import as_col
from tallyspark.operators.dedup import dedup_first, nulls_last

OVERALL = "overall"


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def step_funnel(df: DataFrame, keys: Sequence, order: Sequence, allowed: Column,
                credit: Column, adjusted: Column) -> DataFrame:
    """One row ``base_rows, deduped_rows, filtered_rows, credit_rows,
    adjusted_rows`` — base, after keep-first dedup, after the code filter,
    credit-sign rows and withholding-adjusted rows among the filtered."""
    base = df.select(F.count(F.lit(1)).cast("bigint")).scalar()
    d = dedup_first(df, keys, order)
    return d.agg(F.count(F.lit(1)).cast("bigint").alias("deduped_rows"),
                 _count_if(allowed).alias("filtered_rows"),
                 _count_if(allowed & credit).alias("credit_rows"),
                 _count_if(allowed & adjusted).alias("adjusted_rows")) \
            .select(base.alias("base_rows"), "deduped_rows", "filtered_rows", "credit_rows", "adjusted_rows")


def dedup_sensitivity(df: DataFrame, variants: Mapping[str, tuple], ok_col: str) -> DataFrame:
    """For every variant ``name → (keys, order, pre_filter or None)`` the
    rows kept by keep-first dedup (``name``) and how many of them pass
    ``ok_col`` (``name_ok``), plus ``base_rows``; one output row.

    One scan and one shuffle for all variants. Keys that all variants share (an order number) deal the
    rows, each shuffled once and as it is; every variant then numbers the rows of its groups
    where they are. Rows with one value of the shared keys meet in one task; variants that share no
    key go by :func:`sensitivity_by_variant`, where they don't.
    """
    parts = [{str(as_col(k)): as_col(k) for k in keys} for keys, _, _ in variants.values()]
    shared = [c for text, c in parts[0].items() if all(text in p for p in parts)] if parts else []
    if not shared:
        return sensitivity_by_variant(df, variants, ok_col)
    out, firsts = df.withColumn("_ok", F.coalesce(F.col(ok_col), F.lit(False))).repartition(*shared), {}
    for i, (name, (keys, order, pre)) in enumerate(variants.items()):
        counts = [] if pre is None else [F.coalesce(pre, F.lit(False))]  # rows that don't count are groups apart
        w = Window.partitionBy(*[as_col(k) for k in keys], *counts).orderBy(*nulls_last(order))
        out = out.withColumn(f"_first{i}", F.row_number().over(w) == 1)
        out = out.withColumn(f"_first{i}", F.col(f"_first{i}") & counts[0]) if counts else out
        firsts[name] = F.col(f"_first{i}")
    cols = [F.count(F.lit(1)).cast("bigint").alias("base_rows")]
    for name, first in firsts.items():
        cols += [F.count_if(first).cast("bigint").alias(name), F.count_if(first & F.col("_ok")).cast("bigint").alias(f"{name}_ok")]
    return out.agg(*cols)


def sensitivity_by_variant(df: DataFrame, variants: Mapping[str, tuple], ok_col: str) -> DataFrame:
    """:func:`dedup_sensitivity` for keys of any kind: each row stands once for each variant with the
    variant's key and order, and of each (variant, key) only the flag of the first row is kept, by a
    partial aggregate before the shuffle. Key parts are compared as text.
    """
    orders = {name: [x for c in order for x in (as_col(c).isNull(), as_col(c))] for name, (_, order, _) in variants.items()}
    places = {name: F.struct(F.lit(0), *o) for name, o in orders.items()}
    kinds = df.select(*[p.alias(n) for n, p in places.items()]).schema
    base_of = next((n for n, (_, _, pre) in variants.items() if pre is None), None)

    def stands(name, keys, pre):
        key = F.array(*[as_col(k).cast("string") for k in keys])
        fields = [(places[n] if n == name else F.lit(None).cast(kinds[n].dataType)).alias(f"p{i}") for i, n in enumerate(variants)]
        one = F.struct(F.lit(name).alias("variant"), key.alias("key"), *fields)
        return one if pre is None else F.when(pre, one)

    each = [stands(name, keys, pre) for name, (keys, _, pre) in variants.items()]
    if base_of is None:
        each.append(F.struct(F.lit("").alias("variant"), F.array().cast("array<string>").alias("key"),
                             *[F.lit(None).cast(kinds[n].dataType).alias(f"p{i}") for i, n in enumerate(variants)]))
    rows = df.select(F.col(ok_col).alias("_ok"), F.explode(F.array(*each)).alias("_v")).where(F.col("_v").isNotNull()).select("_ok", "_v.*")
    # a row has the place of its own variant alone, and rows without a place don't count
    firsts = rows.groupBy("variant", "key").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(*[F.min_by(F.coalesce("_ok", F.lit(False)), f"p{i}") for i in range(len(variants))]).alias("_ok"))
    cols = [F.coalesce(F.sum(F.when(F.col("variant") == (base_of or ""), F.col("_n"))), F.lit(0)).cast("bigint").alias("base_rows")]
    for name in variants:
        mine = F.col("variant") == name
        cols += [F.count_if(mine).cast("bigint").alias(name), F.count_if(mine & F.col("_ok")).cast("bigint").alias(f"{name}_ok")]
    return firsts.agg(*cols)


def class_delta_counts(a: DataFrame, b: DataFrame, a_cls: str, b_cls: str, classes: Sequence[str],
                       b_minus_a: bool = True) -> DataFrame:
    """Rows per class on both sides and their delta (B − A as in the
    scripts, or A − B as in the application). One row per listed class."""
    u = (a.select(F.col(a_cls).alias("cls"), F.lit(True).alias("is_a"))
          .unionByName(b.select(F.col(b_cls).alias("cls"), F.lit(False).alias("is_a"))))
    aggs = []
    for c in classes:
        aggs += [_count_if((F.col("cls") == c) & F.col("is_a")).alias(f"a_{c}"),
                 _count_if((F.col("cls") == c) & ~F.col("is_a")).alias(f"b_{c}")]
    wide = u.agg(*aggs)
    stack = ", ".join(f"'{c}', a_{c}, b_{c}" for c in classes)
    out = wide.selectExpr(f"stack({len(classes)}, {stack}) as (cls, a_n, b_n)")
    delta = (F.col("b_n") - F.col("a_n")) if b_minus_a else (F.col("a_n") - F.col("b_n"))
    return out.withColumn("delta", delta.cast("bigint"))


def with_overall(df: DataFrame, group_col: str,
                 fn: Callable[[DataFrame, list], DataFrame]) -> DataFrame:
    """Run a grouped aggregation per group *and* overall in one pass: every
    row is emitted twice (its group and ``overall``) before the partial
    aggregation, the same Expand a ROLLUP uses."""
    doubled = df.withColumn(group_col, F.explode(F.array(F.col(group_col).cast("string"), F.lit(OVERALL))))
    return fn(doubled, [group_col])
