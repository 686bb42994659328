"""The driver tables seen as two ledgers.

``lineitem`` plays the register (side A): one row per line, duplicates on
``(l_orderkey, l_linenumber)``, ``l_returnflag = 'A'`` is the credit sign and
``l_returnflag || l_linestatus`` maps to a protocol code. ``orders`` plays the
portal (side B): one row per order, status ``P`` = paper (no electronic id).

Only column renames and derived columns happen here; every read is a
parquet scan whose projection and filters Catalyst pushes into the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.codes import code_class
from tallyspark.functions.numbers import PARSE_TYPE, signed_amount, to_money
from tallyspark.operators.dedup import dedup_first

# Order that makes "first row" of a duplicated (l_orderkey, l_linenumber)
# total on the driver tables (checked: no ties at any scale factor).
LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_KEY = ["l_orderkey", "l_linenumber"]

# How the six (returnflag, linestatus) pairs play protocol codes: three paper
# codes, two electronic codes, one self-invoice code.
PROTOCOL_OF_PAIR = {"AF": "P", "NF": "2P", "RF": "L", "AO": "EP", "NO": "EL", "RO": "AFIC"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def protocol(rf="l_returnflag", ls="l_linestatus") -> Column:
    pair = F.concat(F.col(rf), F.col(ls))
    out = None
    for k, v in PROTOCOL_OF_PAIR.items():
        out = (F.when(pair == k, F.lit(v)) if out is None else out.when(pair == k, F.lit(v)))
    return out


def money(c) -> Column:
    """Double with 2 decimals → exact ``decimal(18,2)``."""
    return to_money(F.col(c) if isinstance(c, str) else c)


def withholding(price="l_extendedprice", disc="l_discount") -> Column:
    """Withholding = price × discount, half-even to cents (exact decimals)."""
    return to_money(F.col(price).cast("decimal(18,2)") * F.col(disc).cast("decimal(18,2)"))


def lines_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 on the register: first row per (l_orderkey, l_linenumber)."""
    return dedup_first(read(spark, sf_dir, "lineitem"), LINE_KEY, LINE_ORDER)


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side A: de-duplicated, signed register rows.

    Columns: k, ln, d, q, rf, ls, pk, sk, code, proto, cls, pcls, amt, price, w.
    ``cls`` is paper for line status F, else electronic (the comparison's
    simple split); ``pcls`` is the protocol class of ``proto``.
    """
    li = lines_deduped(spark, sf_dir)
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"),
        F.col("l_shipdate").alias("d"), F.col("l_quantity").alias("q"),
        F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.concat("l_returnflag", "l_linestatus").alias("code"),
        protocol().alias("proto"),
        F.when(F.col("l_linestatus") == "F", "paper").otherwise("electronic").alias("cls"),
        code_class(protocol()).alias("pcls"),
        signed_amount("l_extendedprice", "l_returnflag").alias("amt"),
        money("l_extendedprice").alias("price"),
        withholding().alias("w"),
        F.col("l_tax").cast(PARSE_TYPE).alias("tax_rate"),
    )


def portal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side B: one row per order. Columns: k, d, cu, status, cls, amt."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"),
        F.col("o_custkey").alias("cu"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "P", "paper").otherwise("electronic").alias("cls"),
        money("o_totalprice").alias("amt"),
    )


def finish(df: DataFrame) -> DataFrame:
    """Output edge: decimals → double, timestamps/dates → ``yyyy-MM-dd``."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype.startswith("decimal"):
            c = c.cast("double")
        elif dtype.startswith("timestamp") or dtype == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(name))
    return df.select(*cols)
