"""Two-ledger reconciliation.

Conventions: side A is the register, side B the portal. Functions take the
key column, the amount column (exact decimal) and row orders as parameters.
Id keys should be non-NULL (``normalize_id`` maps NULL to ""); the composite
keys of J4 and J11 may be NULL, which equals NULL there.

Plan shape, chosen for scale:

* every keyed comparison aggregates each side by key first (partial
  aggregation map-side, so a hot key costs one row per task) and joins the
  two aggregates — a join of at most one row per key and side, with both
  inputs already hash-partitioned on the key (no extra exchange);
* empty ids are split off before any grouping or join, because "" is the
  one key that can hold a large share of all rows;
* row-level outputs (representative rows, drill-downs) join the raw rows to
  the aggregated decision and rank only what is needed; keys present on one
  side only are never ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.common import as_col
from tallyspark.functions.numbers import SUM_TYPE
from tallyspark.functions.text import is_empty_id
from tallyspark.operators.aggregates import rows_and_sum_by_key
from tallyspark.operators.dedup import dedup_first, nulls_last
from tallyspark.operators.skew import bucket_cuts, order_bucket, take_by_bucket

ONLY_A, ONLY_B, BOTH_DIFFER, DIFFERENT_AMOUNT = "only_a", "only_b", "both_differ", "different_amount"
ONLY_A_EMPTY_ID = "only_a_empty_id"


def _zero() -> Column:
    return F.lit(0).cast(SUM_TYPE)


def _tol(tol) -> Column:
    """Tolerance as an exact decimal: the comparison stays decimal, never
    double."""
    return F.lit(Decimal(str(tol)))


# --------------------------------------------------------------------- J1
def compare_summary(a: DataFrame, b: DataFrame, a_cls: str = "cls", b_cls: str = "cls",
                    a_amt: str = "amt", b_amt: str = "amt",
                    classes: Sequence[str] = ("paper", "electronic"),
                    total_label: str = "total") -> DataFrame:
    """Per class and in total, rows and sums of both sides and A − B.

    One union of the two thin projections, one aggregation with ROLLUP; the
    result has ``len(classes) + 1`` rows. Classes missing from the data
    still appear (zero-filled) because the classes are a fixed list.
    """
    cls_list = list(classes)
    u = (a.select(as_col(a_cls).alias("cls"), F.lit(True).alias("is_a"), as_col(a_amt).alias("amt"))
          .unionByName(b.select(as_col(b_cls).alias("cls"), F.lit(False).alias("is_a"),
                                as_col(b_amt).alias("amt")))
          .where(F.col("cls").isin(*cls_list)))
    agg = (u.rollup("cls").agg(
        F.sum(F.when(F.col("is_a"), 1).otherwise(0)).cast("bigint").alias("a_n"),
        F.coalesce(F.sum(F.when(F.col("is_a"), F.col("amt"))).cast(SUM_TYPE), _zero()).alias("a_amt"),
        F.sum(F.when(~F.col("is_a"), 1).otherwise(0)).cast("bigint").alias("b_n"),
        F.coalesce(F.sum(F.when(~F.col("is_a"), F.col("amt"))).cast(SUM_TYPE), _zero()).alias("b_amt"),
        F.grouping("cls").alias("_g")))
    spark = a.sparkSession
    frame = spark.createDataFrame([(c, i) for i, c in enumerate(cls_list)] + [(total_label, len(cls_list))],
                                  "category string, pos int")
    agg = agg.select(F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col("cls")).alias("category"),
                     "a_n", "a_amt", "b_n", "b_amt")
    out = frame.join(agg, "category", "left")
    return out.select(
        "category", "pos",
        F.coalesce("a_n", F.lit(0)).cast("bigint").alias("a_n"),
        F.coalesce("a_amt", _zero()).alias("a_amt"),
        F.coalesce("b_n", F.lit(0)).cast("bigint").alias("b_n"),
        F.coalesce("b_amt", _zero()).alias("b_amt"),
    ).withColumn("delta_n", F.col("a_n") - F.col("b_n")) \
     .withColumn("delta_amt", (F.col("a_amt") - F.col("b_amt")).cast(SUM_TYPE))


# ------------------------------------------------------------- J2/J3 base
def keyed_sums(a: DataFrame, b: DataFrame, a_key: str = "k", b_key: str = "k",
               a_amt: str = "amt", b_amt: str = "amt") -> DataFrame:
    """A6 on both sides + full outer join: one row per key with
    ``a_rows, a_sum, b_rows, b_sum, delta_rows, delta_sum`` (0 when absent).

    J2, J3, J5 and J10 are projections of this one table.
    """
    ga = rows_and_sum_by_key(a, a_key, a_amt, "a")
    gb = rows_and_sum_by_key(b, b_key, b_amt, "b")
    m = ga.join(gb, "k", "full")
    return m.select(
        "k",
        F.coalesce("a_rows", F.lit(0)).cast("bigint").alias("a_rows"),
        F.coalesce("a_sum", _zero()).alias("a_sum"),
        F.coalesce("b_rows", F.lit(0)).cast("bigint").alias("b_rows"),
        F.coalesce("b_sum", _zero()).alias("b_sum"),
    ).withColumn("delta_rows", F.col("a_rows") - F.col("b_rows")) \
     .withColumn("delta_sum", (F.col("a_sum") - F.col("b_sum")).cast(SUM_TYPE))


def _outcome() -> Column:
    return (F.when(F.col("b_rows") == 0, F.lit(ONLY_A))
             .when(F.col("a_rows") == 0, F.lit(ONLY_B))
             .otherwise(F.lit(BOTH_DIFFER)))


def reconcile_sums(a: DataFrame, b: DataFrame, a_key: str = "k", b_key: str = "k",
                   a_amt: str = "amt", b_amt: str = "amt", tol: float = 0.01,
                   empty_id_rule: str | None = "strict", with_total: bool = False) -> DataFrame:
    """Keys whose row counts differ or whose sums differ by more than
    ``tol``; outcome only_a / only_b / both_differ.

    A rows with an empty key (``empty_id_rule``; None disables the split)
    never join a B key: in the same pass over A they form one NULL-key group
    and come back as one ``only_a_empty_id`` row (key ""). ``with_total`` appends a ``total`` row over the listed rows (so
    residuals ≤ tol with equal counts are not in it).
    Columns: outcome, k, a_rows, a_sum, b_rows, b_sum, delta_rows, delta_sum.
    """
    # One pass over A: empty ids become a NULL key. The NULL group is one
    # row after the (map-side partial) aggregation and never matches in the
    # outer join, so it comes out alone and is relabelled.
    key = as_col(a_key)
    if empty_id_rule is not None:
        a = a.withColumn("_rk", F.when(~is_empty_id(key, empty_id_rule), key))
        key = F.col("_rk")
    m = keyed_sums(a, b, key, b_key, a_amt, b_amt)
    listed = m.where((F.col("delta_rows") != 0) | (F.abs("delta_sum") > _tol(tol)))
    if empty_id_rule is not None:
        empty = F.col("k").isNull() & (F.col("a_rows") > 0) & (F.col("b_rows") == 0)
        outcome = F.when(empty, F.lit(ONLY_A_EMPTY_ID)).otherwise(_outcome())
        k = F.when(empty, F.lit("")).otherwise(F.col("k").cast("string"))
    else:
        outcome, k = _outcome(), F.col("k")
    listed = listed.select(outcome.alias("outcome"), k.alias("k"), "a_rows", "a_sum", "b_rows", "b_sum",
                           "delta_rows", "delta_sum")
    if with_total:
        t = listed.agg(F.lit("total").alias("outcome"), F.lit(None).cast(listed.schema["k"].dataType).alias("k"),
                       F.sum("a_rows").cast("bigint").alias("a_rows"),
                       F.coalesce(F.sum("a_sum").cast(SUM_TYPE), _zero()).alias("a_sum"),
                       F.sum("b_rows").cast("bigint").alias("b_rows"),
                       F.coalesce(F.sum("b_sum").cast(SUM_TYPE), _zero()).alias("b_sum"),
                       F.coalesce(F.sum("delta_rows"), F.lit(0)).cast("bigint").alias("delta_rows"),
                       F.coalesce(F.sum("delta_sum").cast(SUM_TYPE), _zero()).alias("delta_sum"))
        listed = listed.unionByName(t)
    return listed


def reconcile_amounts(a: DataFrame, b: DataFrame, a_key: str = "k", b_key: str = "k",
                      a_amt: str = "amt", b_amt: str = "amt", tol: float = 0.01,
                      empty_id_rule: str | None = "strict") -> DataFrame:
    """only_a, only_b, and different_amount (both present, |Δ| > tol).
    Equal sums with different row counts are *not* listed; no empty-id row."""
    if empty_id_rule is not None:
        a = a.where(~is_empty_id(as_col(a_key), empty_id_rule))
    m = keyed_sums(a, b, a_key, b_key, a_amt, b_amt)
    outcome = (F.when((F.col("a_rows") > 0) & (F.col("b_rows") == 0), F.lit(ONLY_A))
                .when((F.col("b_rows") > 0) & (F.col("a_rows") == 0), F.lit(ONLY_B))
                .when(F.abs("delta_sum") > _tol(tol), F.lit(DIFFERENT_AMOUNT)))
    return (m.select(outcome.alias("outcome"), "k", "a_rows", "a_sum", "b_rows", "b_sum", "delta_sum")
              .where(F.col("outcome").isNotNull()))


# --------------------------------------------------------------------- J4
def multiset_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], a_order: Sequence,
                  b_order: Sequence, a_amt: str | None = "amt", b_amt: str | None = "amt",
                  sides: Sequence[str] = ("a", "b")) -> DataFrame:
    """Multiset difference with representative rows.

    For every key with ``n_a > n_b`` the first ``n_a - n_b`` A rows in
    ``a_order`` are emitted (``outcome = only_a``, ``delta = amount``), and
    symmetrically for B (``delta = -amount``). NULL is a key like others. All
    input columns are kept (B columns are those of ``b``; the union is by name,
    missing → NULL). With ``a_amt``/``b_amt`` None no ``delta`` column is added.
    ``sides`` limits the output to one side's surplus. The orders should be
    total; rows that tie are interchangeable.

    One aggregation over both sides counts rows by key and bucket of the order
    (:func:`tallyspark.operators.skew.order_bucket`); sums along the buckets tell which of them the
    surplus reaches, and rows are ranked only within (key, bucket). So no key is gathered in one
    task, and the plan is lazy: no job runs while it is built.
    """
    keys = list(keys)

    def bucketed(df, order, wanted):
        return df.withColumn("_bucket", order_bucket(df, order) if wanted else F.lit(0).cast("bigint"))

    a, b = bucketed(a, a_order, "a" in sides), bucketed(b, b_order, "b" in sides)
    tagged = a.select(*keys, F.lit("a").alias("_side"), "_bucket").unionByName(b.select(*keys, F.lit("b").alias("_side"), "_bucket"))
    counts = tagged.groupBy(*keys, "_side", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    mine, all_of_key = F.sum("_n").over(Window.partitionBy(*keys, "_side")), F.sum("_n").over(whole)
    counts = counts.withColumn("_cut", 2 * mine - all_of_key)  # own rows less those of the other side

    def side(df, label, order, amt, outcome, sign):
        cuts = bucket_cuts(counts.where((F.col("_side") == label) & (F.col("_cut") > 0)), keys)
        out = take_by_bucket(df, cuts, keys, order).withColumn("outcome", F.lit(outcome))
        if amt is None:
            return out
        return out.withColumn("delta", (as_col(amt) * F.lit(sign)).cast(SUM_TYPE))

    parts = []
    if "a" in sides:
        parts.append(side(a, "a", a_order, a_amt, ONLY_A, 1))
    if "b" in sides:
        parts.append(side(b, "b", b_order, b_amt, ONLY_B, -1))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --------------------------------------------------------------------- J5
def top_delta_detail(a: DataFrame, b: DataFrame, key: str = "k", a_amt: str = "amt", b_amt: str = "amt",
                     a_order: Sequence = (), b_order: Sequence = (), top_n: int = 30,
                     per_side: int = 20, cols: Sequence[str] = ()) -> DataFrame:
    """The ``top_n`` keys by |A − B| (ties by key), then at most
    ``per_side`` rows of each side per key in the given orders.

    Output: ``k, side ('a'/'b'), rn`` + ``cols`` (taken from each side).
    The top-key list has exactly ``top_n`` rows, so broadcasting it is
    always safe; the per-key cut is a ``WindowGroupLimit``.
    """
    m = keyed_sums(a, b, key, key, a_amt, b_amt)
    top = m.orderBy(F.abs("delta_sum").desc(), F.col("k").asc_nulls_last()).limit(top_n).select("k")
    top = F.broadcast(top)

    def side(df, label, order, amt):
        rows = df.join(top, df[key] == top["k"], "left_semi")
        w = Window.partitionBy(key).orderBy(*nulls_last(order))
        ranked = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_side)
        return ranked.select(F.col(key).alias("k"), F.lit(label).alias("side"),
                             F.col("rn").cast("bigint").alias("rn"),
                             *[as_col(c) for c in cols], as_col(amt).alias("amt"))

    return side(a, "a", a_order, a_amt).unionByName(side(b, "b", b_order, b_amt))


# --------------------------------------------------------------------- J6
def unmatched(a: DataFrame, b: DataFrame, key: str = "k", a_order: Sequence = (),
              b_order: Sequence = (), empty_id_rule: str = "strict") -> DataFrame:
    """B-only keys (first B row each), A-only keys (first A row
    each) and every A row with an empty key, as one table with a ``section``
    column (union by name). Empty keys of either side, NULL among them, match
    nothing; those of B are left out.

    One scan of each side and one grouped aggregate: of each key the first row of
    either side and so whether it is there at all. The partial aggregate leaves one
    row a key and task, so a hot key is harmless; an A row with an empty key is a
    group of its own, so these spread over all tasks.
    """
    names = list(dict.fromkeys([*a.columns, *b.columns]))
    types = {f.name: f.dataType for f in [*b.schema, *a.schema]}

    def thin(df, mine, order):
        cols = [(F.col(f"`{c}`").cast(types[c]) if c in df.columns else F.lit(None).cast(types[c])).alias(c) for c in names]
        # NULLs last, as everywhere
        place = [x for c in order for x in (as_col(c).isNull(), as_col(c))]
        return df.select(as_col(key).alias("_key"), is_empty_id(as_col(key), empty_id_rule).alias("_empty"), F.lit(mine).alias("_a"),
                         F.struct(F.lit(0), *place).alias("_place"), F.struct(*cols).alias("_r"))

    ta, tb = thin(a, True, a_order), thin(b, False, b_order).where(~F.col("_empty"))
    none = lambda t: F.lit(None).cast(t.schema["_place"].dataType)
    tagged = (ta.withColumns({"_pa": F.col("_place"), "_pb": none(tb)}).drop("_place")
              .unionByName(tb.withColumns({"_pa": none(ta), "_pb": F.col("_place")}).drop("_place")))
    groups = tagged.withColumn("_own", F.when(F.col("_empty"), F.monotonically_increasing_id())).groupBy("_key", "_own").agg(
        F.min_by("_r", "_pa").alias("_ra"), F.min_by("_r", "_pb").alias("_rb"),
        F.bool_or("_a").alias("_has_a"), F.bool_and("_a").alias("_only_a"))
    section = (F.when(F.col("_own").isNotNull(), F.lit(ONLY_A_EMPTY_ID)).when(F.col("_only_a"), F.lit(ONLY_A))
                .when(~F.col("_has_a"), F.lit(ONLY_B)))
    listed = groups.select(F.when(F.col("_has_a"), F.col("_ra")).otherwise(F.col("_rb")).alias("_r"), section.alias("section"))
    return listed.where(F.col("section").isNotNull()).select(*[F.col("_r")[c].alias(c) for c in names], "section")


# --------------------------------------------------------------------- J7
def one_to_one(a: DataFrame, b: DataFrame, key: str = "k", a_amt: str = "amt", b_amt: str = "amt",
               tol: float = 0.01) -> DataFrame:
    """Keys that occur exactly once on each side and whose
    amounts differ by more than ``tol``: ``k, a_amt, b_amt, delta``."""
    ga = rows_and_sum_by_key(a, key, a_amt, "a").where(F.col("a_rows") == 1)
    gb = rows_and_sum_by_key(b, key, b_amt, "b").where(F.col("b_rows") == 1)
    j = ga.join(gb, "k", "inner")
    return (j.select("k", F.col("a_sum").alias("a_amt"), F.col("b_sum").alias("b_amt"),
                     (F.col("a_sum") - F.col("b_sum")).cast(SUM_TYPE).alias("delta"))
             .where(F.abs("delta") > _tol(tol)))


# --------------------------------------------------------------------- J8
def arrival_lookup(b: DataFrame, a_filtered: DataFrame, a_all: DataFrame, key: str = "k",
                   date_col: str = "d", b_order: Sequence = (), empty_id_rule: str = "strict") -> DataFrame:
    """The first B row (in ``b_order``, by default the key alone) of each
    non-empty key that is not in the filtered A table, looked up in the
    unfiltered A table: months in which the key occurs (sorted text),
    their count, first/last month number (yyyymm) and first date.
    Keys found nowhere get ``n_months = 0`` and NULLs."""
    b_only = b.where(~is_empty_id(F.col(key), empty_id_rule)).join(a_filtered.select(key).distinct(), key, "left_anti")
    b_only = dedup_first(b_only, [key], list(b_order) or [key])
    d = F.col(date_col)
    ym = F.year(d) * 100 + F.month(d)
    per_month = (a_all.where(d.isNotNull())
                 .groupBy(F.col(key).alias(key), ym.alias("_ym"))
                 .agg(F.min(d).alias("_first")))
    lookup = per_month.groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_months"),
        F.min("_ym").cast("bigint").alias("m0"), F.max("_ym").cast("bigint").alias("m1"),
        F.array_join(F.array_sort(F.collect_list(
            F.format_string("%04d-%02d", (F.col("_ym") / 100).cast("int"), F.col("_ym") % 100))), ", ")
        .alias("months"),
        F.min("_first").alias("first_reg"))
    return (b_only.join(lookup, key, "left")
                  .withColumn("n_months", F.coalesce("n_months", F.lit(0)).cast("bigint"))
                  .withColumn("months", F.coalesce("months", F.lit(""))))


# --------------------------------------------------------------------- J9
def unmatched_by_columns(b: DataFrame, a: DataFrame, cols: Sequence[str], order: Sequence,
                         sample: int = 2) -> DataFrame:
    """B rows whose composite key (several columns, not a concatenated
    string) has no A row: the first ``sample`` of them in ``order`` with
    ``rank`` 1..sample and the total ``n_unmatched`` (a scalar subquery).
    A NULL part equals NULL."""
    cols = list(cols)
    there = a.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(cols)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_l{i}"))
    miss = b.join(there, same, "left_anti")
    n = miss.select(F.count(F.lit(1)).cast("bigint")).scalar()
    top = miss.orderBy(*nulls_last(order)).limit(sample)
    # ``top`` holds at most ``sample`` rows: ranking it in one task is free.
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*nulls_last(order))).cast("bigint"))
    return top.withColumn("n_unmatched", n)


# -------------------------------------------------------------------- J10
def delta_by_sum_class(a: DataFrame, b: DataFrame, key: str = "k", a_amt: str = "amt", b_amt: str = "amt",
                       top: int = 10) -> DataFrame:
    """Keys classified by *sum* (a key whose rows net to 0 counts as
    absent): only_a / only_b / both with key counts and sums (only_a: A sum,
    only_b: B sum, both: Δ sum), plus the ``top`` shared keys by |Δ|.
    Empty keys are *not* removed. Columns: section, k, n_keys, a_sum, b_sum,
    delta."""
    m = keyed_sums(a, b, key, key, a_amt, b_amt)
    cls = (F.when((F.col("a_sum") != 0) & (F.col("b_sum") == 0), F.lit(ONLY_A))
            .when((F.col("b_sum") != 0) & (F.col("a_sum") == 0), F.lit(ONLY_B))
            .when((F.col("a_sum") != 0) & (F.col("b_sum") != 0), F.lit("both")))
    c = m.withColumn("section", cls).where(F.col("section").isNotNull())
    summary = (c.groupBy("section").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_keys"),
        F.sum("a_sum").cast(SUM_TYPE).alias("a_sum"), F.sum("b_sum").cast(SUM_TYPE).alias("b_sum"),
        F.sum("delta_sum").cast(SUM_TYPE).alias("delta"))
        .withColumn("k", F.lit(None).cast(m.schema["k"].dataType)))
    shared = (c.where(F.col("section") == "both")
               .orderBy(F.abs("delta_sum").desc(), F.col("k").asc_nulls_last()).limit(top)
               .select(F.lit("top_shared").alias("section"), "k", F.lit(1).cast("bigint").alias("n_keys"),
                       "a_sum", "b_sum", F.col("delta_sum").alias("delta")))
    return summary.unionByName(shared)


# -------------------------------------------------------------------- J11
REASON_FULL = "full_match"
REASON_AMOUNT = "other_amount"
REASON_NAME = "other_name"
REASON_CLASS = "other_class"
REASON_NOT_FOUND = "not_found"


def classify_mismatch(a_all: DataFrame, b_paper: DataFrame, num: str = "num", dt: str = "dt",
                      name: str = "nm", amt: str = "am", a_is_paper: str = "is_paper",
                      b_order: Sequence = ("k",)) -> DataFrame:
    """Why surplus paper B rows have no paper A counterpart.

    1. Multiset surplus of B over paper A on the 4-part key
       (num, dt, name, amt): per key, the first ``n_b - n_a`` B rows.
    2. Cut: the first ``max(0, |B| - |paper A|)`` surplus rows in
       ``b_order`` (the number is one scalar aggregate; the cut is exact, by
       counts along buckets of the order, not one big ordered take).
    3. Reasons, by looking up (num, dt) in A: a paper row with the same
       name and amount → full_match; same name → other_amount; any paper
       row → other_name; any A row → other_class; else not_found.

    Step 3 joins each cut row to *pre-aggregated* A flags (one row per
    (num, dt), (num, dt, name) and (num, dt, name, amt)), never to all A rows
    of a (num, dt) pair, so the work stays linear in the input.
    Returns ``reason, n`` (one row per reason that occurs).
    """
    keys = [num, dt, name, amt]
    a_paper = a_all.where(F.col(a_is_paper))
    surplus = multiset_diff(a_paper.select(*keys), b_paper, keys, [F.lit(0)], list(b_order),
                            None, None, sides=("b",))
    # how many: one scalar of the same plan
    diff = (b_paper.select(F.lit(1).alias("_s"))
            .unionByName(a_paper.select(F.lit(-1).alias("_s")))
            .agg(F.greatest(F.coalesce(F.sum("_s"), F.lit(0)), F.lit(0)))).scalar()
    # The first ``diff`` surplus rows in ``b_order``: ``diff`` grows with the
    # data, so they are cut by buckets of the order instead of ``orderBy.limit``.
    rows = surplus.select(*keys, *[c for c in _names(b_order) if c not in keys])
    rows = rows.withColumn("_bucket", order_bucket(rows, list(b_order)))
    cut = take_by_bucket(rows, bucket_cuts(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cut", diff), []), [], list(b_order))

    # aggregated once at the finest key, and from there upwards
    full = a_all.groupBy(*keys).agg(F.max(F.when(F.col(a_is_paper), 1).otherwise(0)).alias("pna"))
    by_name = full.groupBy(num, dt, name).agg(F.max("pna").alias("pn"))
    by_pair = by_name.groupBy(num, dt).agg(F.max("pn").alias("p"), F.lit(1).alias("anyc"))

    def looked_up(rows, table, on):
        # NULL parts of a key match NULL
        named = table.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(on)], *[c for c in table.columns if c not in on])
        same = F.lit(True)
        for i, k in enumerate(on):
            same = same & F.col(k).eqNullSafe(F.col(f"_l{i}"))
        return rows.join(named, same, "left").drop(*[f"_l{i}" for i in range(len(on))])

    j = looked_up(looked_up(looked_up(cut, by_pair, [num, dt]), by_name, [num, dt, name]), full, keys)
    reason = (F.when(F.col("pna") == 1, F.lit(REASON_FULL))
               .when(F.col("pn") == 1, F.lit(REASON_AMOUNT))
               .when(F.col("p") == 1, F.lit(REASON_NAME))
               .when(F.col("anyc") == 1, F.lit(REASON_CLASS))
               .otherwise(F.lit(REASON_NOT_FOUND)))
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def _names(cols: Sequence) -> list[str]:
    return [c for c in cols if isinstance(c, str)]
