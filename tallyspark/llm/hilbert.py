"""Sharding along a Hilbert curve (operator 6).

Several metadata columns are quantised to cells of a grid, rows are ordered by their cell's index
on a Hilbert curve through the grid, and the order is cut into runs of equal row counts. Rows of
one shard then span a small range of every dimension, so minima and maxima of files prune on any
of them. Law ``rows``: the counts of two shards differ by one at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import stored, table

BITS = 5
SHARDS = 8


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of ``cells`` (integers from 0 to 2^bits - 1, a column for
    each dimension): bit planes are taken from the highest, undoing the turn that each step of the
    curve makes, and the Gray code of the interleaved bits is then decoded."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        q = 1 << plane
        low = q - 1
        for d in range(dims):
            up = (x[d] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> plane) & 1)
    return out


def index_column(cells: Sequence[Column], bits: int = BITS) -> Column:
    @F.pandas_udf(T.LongType())
    def run(*dims: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([d.to_numpy(np.int64) for d in dims], 1), bits))

    return run(*cells)


def name_cell(col: Column, cuts: Sequence[str]) -> Column:
    """A name's cell, growing with the name: how many of the sorted ``cuts`` don't come after it, less
    one. Null names are as the empty one."""
    name = F.coalesce(col.cast("string"), F.lit(""))
    return F.greatest(F.lit(0), sum((F.when(name >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(-1))).cast("int")


def name_cuts(df: DataFrame, name: str, bits: int = BITS) -> list[str]:
    """The first name of each cell: the sorted distinct names in 2^bits runs of equal counts (fewer names:
    a cell each, spread over the range by repeating the first). At most 2^bits names reach the driver."""
    names = ranked(df.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name")).distinct(), ["name"])
    cells = 1 << bits
    firsts = names.groupBy(F.expr(f"rank * {cells} div rows").alias("cell")).agg(F.min("name").alias("name")).collect()
    out, reached = [], 0
    for cell, first in sorted((r["cell"], r["name"]) for r in firsts):
        out += [first] * (cell + 1 - reached)
        reached = cell + 1
    return out


def size_cell(col: Column, bits: int = BITS) -> Column:
    """A positive number's cell: two to each power of two, so no statistics are needed."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(col.cast("double"), F.lit(1.0))) * 1.5))).cast("int")


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``rank``, each row's place in the order of the columns, from 0. Rows are sorted in
    ranges and stored; only the ranges' row counts pass through the driver."""
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - (F.spark_partition_id().cast("long") * F.lit(1 << 33))))
    counts = {r[0]: r[1] for r in parts.groupBy("_part").count().collect()}  # one row a shuffle partition
    before, firsts = 0, []
    for part in sorted(counts):
        firsts.append((part, before))
        before += counts[part]
    first = parts.sparkSession.createDataFrame(firsts, "_part int, _first long")
    return parts.join(F.broadcast(first), "_part").withColumn("rank", F.col("_first") + F.col("_at")).withColumn("rows", F.lit(before).cast("long")).drop("_part", "_at", "_first")


def hilbert_shards(df: DataFrame, cells: dict[str, Column], order: Sequence[str] = (), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` with ``hilbert`` long, ``shard`` int and ``slot`` long (place in the shard, from 0).

    ``cells``: for each dimension its name and the column of its cell, 0 to 2^bits - 1. Rows of one
    cell are ordered by the columns ``order``; rows that tie there too are alike in what orders them
    and take any order. Columns of ``df`` must not be called hilbert, shard, slot, rank or rows, or
    begin with an underscore. An empty table gives no rows.
    """
    out = ranked(df.withColumn("hilbert", index_column(list(cells.values()), bits)), ["hilbert", *order])
    shard = F.expr(f"(rank * {shards}) div rows")
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"rank - (cast(shard as long) * rows + {shards - 1}) div {shards}")).drop("rank", "rows")


def write_shards(df: DataFrame, path: str, partition: str = "shard", order: Sequence[str] = ("slot",)) -> None:
    """A folder for each shard, its rows in order, so that files and row groups have narrow ranges."""
    df.repartition(partition).sortWithinPartitions(partition, *order).write.partitionBy(partition).parquet(path)


def shard_documents(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, hilbert, shard, slot) for every row of documents.

    Dimensions: size, language and source. Rows of equal texts stand together, in the cell of the one of
    the smallest doc_id (of these, the smallest language and source), so a shard's end cuts at most one such
    group. Nulls: a null text has size 1 and equals the empty text; null languages and sources share
    the empty name's cell. Rows of a cell stand in the order of size, text_crc32, the text's hash, doc_id.
    Repeated rows get a slot each. Other columns of ``df`` are not read. An empty table gives no rows.
    """
    text = F.coalesce(df["text"].cast("string"), F.lit(""))
    rows = df.select(
        df["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), df["lang"].cast("string").alias("lang"), df["source"].cast("string").alias("source"),
    )
    key = ["size", "text_crc32", "text_hash"]
    groups = rows.groupBy(*key).agg(F.min(F.struct("doc_id", "lang", "source")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = rows.join(groups.drop("copies"), key, "left")
    place = {c: F.when(F.col("first").isNotNull(), F.col(f"first.{c}")).otherwise(F.col(c)) for c in ("lang", "source")}
    cells = {"size": size_cell(F.col("size"))} | {c: name_cell(place[c], name_cuts(df, c)) for c in place}
    return hilbert_shards(rows, cells, [*key, "doc_id"], shards).drop("first", "text_hash")


def op6_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
