"""Exact ranking within keys when a key may hold a third of all rows.

``row_number() OVER (PARTITION BY key ORDER BY …)`` puts every row of a key
into one task. When only the first row(s) are kept Spark limits each map
task before the shuffle (``WindowGroupLimit``), which makes hot keys
harmless; when the cut differs per key (multiset difference: keep the first
``n_a - n_b`` rows) it cannot. Here, at any size:

1. rows are range-partitioned on ``(key, order…)`` — Spark samples the sort
   key, so one key spreads over many partitions — and sorted in each;
2. every row gets ``monotonically_increasing_id`` (partition id in the high
   bits, position in the low bits) and the result is materialised with a
   reliable ``checkpoint()`` in the cluster's shared checkpoint folder, so
   later reads see exactly the same ids and lineage is cut (this runs while
   the plan is built);
3. rows are ranked within (partition, key), a group that one range bounds;
4. only a key that goes on from an earlier partition needs an offset, and it
   is the first key of its partition: at most one offset a partition, whatever
   the number of keys, so the offsets are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.common import as_col
from tallyspark.operators.dedup import _has_direction, nulls_last
from tallyspark.session import checkpoint_dir


def rank_in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence, name: str = "_rn",
                   partitions: int | None = None) -> DataFrame:
    """Exact ``row_number`` within ``keys`` in ``order`` (NULLs last; NULL keys
    are one key). With no keys it is a global rank: the first-``n``-rows cut
    whose ``n`` grows with the data, without gathering ``n`` rows in one task.
    Rows that tie in ``order`` get their ranks in any order: give a total one."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    keys = list(keys)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k).asc_nulls_last() for k in keys] + nulls_last(order)
    ided = (rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    spans = ided.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spans.withColumn("_before", F.sum("_cnt").over(before)).where(F.col("_before") > 0)
                    .select(F.col("_pid").alias("_opid"), *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "_before"))
    cond = F.col("_pid") == F.col("_opid")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    local = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy("_mid"))
    out = ided.withColumn(name, local).join(F.broadcast(offsets), cond, "left")
    return (out.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("bigint"))
               .drop("_pid", "_mid", "_opid", "_before", *[f"_o{i}" for i in range(len(keys))]))


#: Above every bucket of a value: where NULL stands.
_LAST = 1 << 40


def order_bucket(df: DataFrame, order: Sequence) -> Column:
    """A small number that never falls along ``order``, from its first column alone and without a look
    at the data: days of dates and times, 64 steps each time a number doubles, the first three bytes
    of text. So a key has at most some thousands of buckets, whatever its rows."""
    if not order or _has_direction(as_col(order[0])):
        return F.lit(0).cast("bigint")
    c = as_col(order[0])
    kind = df.select(c.alias("c")).dtypes[0][1]
    if kind == "date" or kind.startswith("timestamp"):
        bucket = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    elif kind == "string":
        bucket = F.conv(F.rpad(F.substring(F.hex(c.cast("binary")), 1, 6), 6, "0"), 16, 10)
    else:
        v = c.cast("double")
        bucket = F.signum(v) * F.floor(F.log2(F.lit(1.0) + F.abs(v)) * 64)
    return F.coalesce(bucket.cast("bigint"), F.lit(_LAST))


def bucket_cuts(counts: DataFrame, keys: Sequence[str], cut: str = "_cut") -> DataFrame:
    """``counts`` (keys, ``_bucket``, ``_n`` rows, the number ``cut`` of rows to take of the key): the buckets that
    the first ``cut`` rows of a key reach, and how many of each (``_take``)."""
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(cut) - F.coalesce(F.sum("_n").over(before), F.lit(0))
    return counts.withColumn("_take", left).where(F.col("_take") > 0).select(*keys, "_bucket", "_take")


def take_by_bucket(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first rows in ``order`` of every key, as many as ``cuts`` (of :func:`bucket_cuts`) say. Rows meet
    the cuts and are ranked by (key, bucket), so a key that holds a third of all rows is spread over its buckets;
    NULL keys are one key. Give a total order."""
    group = F.struct(*keys, "_bucket")  # NULL parts of a struct are equal
    found = rows.withColumn("_group", group).join(cuts.select(group.alias("_group"), "_take"), "_group")
    place = F.row_number().over(Window.partitionBy("_group").orderBy(*nulls_last(order)))
    return found.withColumn("_place", place).where(F.col("_place") <= F.col("_take")).drop("_group", "_bucket", "_take", "_place")
