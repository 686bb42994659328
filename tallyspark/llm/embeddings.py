"""Embedding near-dedup by sorted projection passes (operator 9).

Equal vectors are one class. In each pass a class gets ``HASH_BITS`` random bits, each the side of a random
hyperplane, and classes are sorted by them, bit by bit from the first, in ranges over all tasks. Each
class is compared with at least the next ``WINDOW`` of the order, cosine in double precision; the last rows
of a range meet the first of the next one. Links of all passes are united into components.

A pair that agrees in its first bits stands in one run of the order. The bits counted on grow with the
logarithm of the number of classes, so that such a run has half a window on average, and the passes
grow with the bits, so that a pair just at the threshold shares a run in some pass with probability ``RECALL``.
Runs longer than the window (dense groups, hubs) are compared whole, dealt in chunks, so no window
cuts their links off.

Then all pairs within each component are compared and the links counted, so that none is missing there,
whatever the size of the group. Long runs and components of many rows are dealt in chunks, a task for
two chunks at a time; no step writes a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import stored, table
from tallyspark.llm.components import components

#: Of a pair just at the threshold, the chance to share a run in some pass.
RECALL = 0.9999
#: Bits that a pass sorts by; rows of the order that each is compared with, at least.
HASH_BITS, WINDOW = 62, 256
#: Rows of a range of the order, on average.
RANGE_ROWS = 100_000
#: Rows of a run longer than the window that are compared in one task; and those of a chunk of a longer run.
WHOLE, CHUNK = 2048, 1024
#: Rows from which a component is cut into chunks, and the chunks it gets before they grow.
COMPONENT, CHUNKS = 64, 32
SEED = 11
#: In the place of a range's number: the row is a link.
LINK = -2

_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_COUNTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("others", T.LongType())])


def unit(vectors: list) -> np.ndarray:
    """Rows of length one, in double precision; vectors are scaled first, lest squares overflow."""
    x = np.stack(vectors).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def planes(seed: int, one_pass: int, dims: int) -> np.ndarray:
    return np.random.default_rng([seed, one_pass, dims]).normal(size=(dims, 64))


def bits_and_passes(classes: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """The first bits that make a run, and the passes. A bit is the same for two vectors with
    probability 1 - angle / pi."""
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(classes, 1) * 2 / WINDOW))))
    meet = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return bits, 1 if meet == 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def signatures_of(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """For each row and pass, the hash bits as a long, the first the highest."""
    out = np.zeros((len(x), passes), np.int64)
    for p in range(passes):
        sides = (x @ planes(seed, p, x.shape[1])[:, :HASH_BITS]) > 0
        out[:, p] = sides @ (np.int64(1) << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64))
    return out


def packed(vector: np.ndarray) -> bytes:
    """Little-endian floats, in single precision if that holds them all."""
    x = np.asarray(vector, "<f8")
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return single.tobytes() if (single == x).all() else x.tobytes()


def unpacked(values: list[bytes], dims: int) -> list[np.ndarray]:
    return [np.frombuffer(v, "<f4" if len(v) == 4 * dims else "<f8") for v in values]


def near_pairs(x: np.ndarray, chunk: np.ndarray, cosine: float) -> np.ndarray:
    """The matrix of links between rows of length one: between all, or if there are two chunks, between
    rows of different ones. Products near the threshold are summed anew in an order that doesn't depend on the
    other rows."""
    product = x @ x.T
    near = product >= cosine
    a, b = np.nonzero(np.abs(product - cosine) < 1e-9)
    for at in range(0, len(a), 1 << 16):
        a1, b1 = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        near[a1, b1] = (x[a1] * x[b1]).sum(axis=1) >= cosine
    np.fill_diagonal(near, False)
    if len(chunk) and chunk.min() != chunk.max():
        near &= chunk[:, None] != chunk[None, :]
    return near


def window_links(part: pd.DataFrame, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what rows of the order link within the window, one fewer than nodes for each
    group of a window. Rows are compared in single precision first, near the threshold and above it in double."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (_, dims), rows in part.groupby(["pass", "dims"], sort=False):
        node, x = rows["node"].to_numpy(), unit(unpacked(rows["v"].tolist(), int(dims)))
        single = x.astype(np.float32)
        for at in range(0, len(x), WINDOW):
            end = min(len(x), at + 2 * WINDOW)
            product = single[at : at + WINDOW] @ single[at:end].T
            i, j = np.nonzero(np.triu(product >= cosine - 1e-4, 1))
            if not len(i):
                continue
            close = product[i, j] < cosine + 1e-4
            sure = ~close
            sure[close] = (x[at + i[close]] * x[at + j[close]]).sum(axis=1) >= cosine
            near = np.zeros((end - at, end - at), bool)
            near[i[sure], j[sure]] = near[j[sure], i[sure]] = True
            one, two = forest(near)
            a.append(node[at + one])
            b.append(node[at + two])
    return np.concatenate(a), np.concatenate(b)


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever the matrix joins, one fewer than nodes for each component."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = near.any(axis=1)
    while left.any():
        edge = np.array([left.argmax()])
        left[edge] = False
        while len(edge):
            reach = near[edge]
            new = np.flatnonzero(reach.any(axis=0) & left)
            a.append(edge[reach[:, new].argmax(axis=0)])
            b.append(new)
            left[new] = False
            edge = new
    return np.concatenate(a), np.concatenate(b)


def groups_of(part: pd.DataFrame, cosine: float) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of each group in ``part``, and the matrix of their links."""
    for (_, dims), rows in part.groupby(["group", "dims"], sort=False):
        if len(rows) > 1:
            x = unit(unpacked(rows["v"].tolist(), int(dims)))
            yield rows, near_pairs(x, rows["chunk"].to_numpy(), cosine)


def dealt(rows: DataFrame, size: str, whole: int, chunk: str, bins: int) -> DataFrame:
    """``rows`` (group, node, and more) with ``bin``, ``chunk``, ``i``, ``j``: a group of more than
    ``whole`` rows in chunks of about ``chunk`` rows, each chunk once for every chunk of the group;
    groups of fewer rows share ``bins`` tasks, or have one each if that is 0."""
    cut = F.when(F.expr(f"{size} > {whole}"), F.expr(f"cast(ceil({size} / {chunk}) as int)")).otherwise(F.lit(1))
    rows = rows.withColumn("chunks", cut).withColumn("chunk", F.expr("cast(pmod(xxhash64(node, 7), chunks) as int)"))
    rows = rows.withColumn("bin", F.when(F.col("chunks") == 1, F.expr(f"pmod(group, {bins})")).otherwise(F.col("group")) if bins else F.col("group"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return rows.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("chunks", "other", size)


def usable(vector: str) -> str:
    """SQL for: not null, not empty, not all zero, and all components finite."""
    finite = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return f"({vector} IS NOT NULL AND size({vector}) > 0 AND {finite} AND exists({vector}, x -> x != 0))"


def near_vectors(df: DataFrame, cosine: float = 0.9, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``df``.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id,
    link with nothing: they have no links, are their own component and are kept. Vectors of different
    lengths never link. Rows that share an id and a vector are one vector, a row each in the result.
    Other columns of ``df`` are not read. An empty table gives no rows.
    """
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))
    rows = rows.withColumn("class", F.when(F.expr(usable("v")) & F.col("vec_id").isNotNull(), F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",").cast("binary"), 256)))
    distinct = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("v").alias("v"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(dims=part["v"].map(len).astype(np.int32), v=part["v"].map(packed))

    # an id with two vectors gives two classes; nodes are told apart by a number
    classes = distinct.withColumn("node", F.xxhash64("class")).withColumn("dims", F.lit(0))
    classes = stored(classes.mapInPandas(pack, "class string, rep long, copies long, v binary, node long, dims int"))
    n_classes = classes.count()
    bits, passes = bits_and_passes(n_classes, cosine, recall)
    order = ["pass", "dims", "signature", "node"]

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dims, same in part.groupby("dims"):
                for at in range(0, len(same), 1000):
                    some = same.iloc[at : at + 1000]
                    found = signatures_of(unit(unpacked(some["v"].tolist(), int(dims))), passes, SEED)
                    yield pd.DataFrame({"pass": np.tile(np.arange(passes), len(some)), "dims": int(dims), "signature": found.ravel(), "node": np.repeat(some["node"].to_numpy(), passes), "v": np.repeat(some["v"].to_numpy(), passes)})

    signed = classes.select("node", "dims", "v").mapInPandas(sign, "pass int, dims int, signature long, node long, v binary")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of a sorted range (``edge`` is LINK), and its first and last rows for the ranges beside it."""
        me, firsts, held = TaskContext.get().partitionId(), 0, None
        for part in parts:
            if firsts < WINDOW:
                some = part.head(WINDOW - firsts)
                firsts += len(some)
                yield some.assign(edge=me - 1, other=0)
            rows = part if held is None else pd.concat([held, part])
            a, b = window_links(rows, cosine)
            yield pd.DataFrame({"pass": 0, "dims": 0, "signature": 0, "node": a, "v": None, "edge": LINK, "other": b})
            held = rows.tail(WINDOW)
        if held is not None:
            yield held.assign(edge=me, other=0)

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = window_links(rows.sort_values(order), cosine)
        return pd.DataFrame({"a": a, "b": b})

    ranges = max(1, math.ceil(n_classes * passes / RANGE_ROWS))
    compared = stored(signed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInPandas(compare, "pass int, dims int, signature long, node long, v binary, edge int, other long"))
    links = compared.where(F.col("edge") == LINK).select(F.col("node").alias("a"), F.col("other").alias("b"))
    links = links.union(compared.where(F.col("edge") != LINK).groupBy("edge").applyInPandas(across, _LINKS))

    # runs of equal first bits that are longer than the window
    runs = signed.withColumn("group", F.xxhash64("dims", "pass", F.shiftright("signature", HASH_BITS - bits))).drop("pass", "signature")
    long_runs = stored(runs.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > WINDOW))
    held = dealt(runs.join(long_runs, "group"), "size", WHOLE, str(CHUNK), 0)

    def link(part: pd.DataFrame) -> pd.DataFrame:
        found = [(rows["node"].to_numpy(), *forest(near)) for rows, near in groups_of(part, cosine)]
        empty = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([empty, *(n[a] for n, a, _ in found)]), "b": np.concatenate([empty, *(n[b] for n, _, b in found)])})

    links = stored(links.union(held.groupBy("bin", "i", "j").applyInPandas(link, _LINKS)).distinct())
    joined = stored(components(links, "a", "b"))

    # within components every pair is compared, and only counts are written
    large = stored(joined.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > COMPONENT))
    members = joined.join(large, "component", "left").join(classes.select("node", "dims", "copies", "v"), "node").withColumnRenamed("component", "group")
    held = dealt(members, "size", COMPONENT, f"greatest({COMPONENT}, least({CHUNK}, ceil(size / {CHUNKS})))", max(1, n_classes // (2 * COMPONENT)))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        found = [(rows["node"].to_numpy(), near @ rows["copies"].to_numpy(np.int64)) for rows, near in groups_of(part, cosine)]
        empty = np.zeros(0, np.int64)
        return pd.DataFrame({"node": np.concatenate([empty, *(n for n, _ in found)]), "others": np.concatenate([empty, *(c for _, c in found)])})

    linked = held.groupBy("bin", "i", "j").applyInPandas(count, _COUNTS).groupBy("node").agg(F.sum("others").alias("others"))
    found = classes.select("class", "node", "rep", "copies").join(linked, "node", "left").join(joined, "node", "left")
    found = found.withColumn("component", F.coalesce("component", "node"))
    smallest = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(smallest, "component").select("class", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "class").join(found, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
