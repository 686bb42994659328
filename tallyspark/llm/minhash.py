"""Near-duplicate documents by b-bit MinHash (operator 10).

1. A text becomes the set of its distinct word shingles (64-bit hashes). ``BANDS`` x ``ROWS`` minima
   are taken; bands of minima give candidate buckets, and ``BITS`` low bits of ``SIGNATURE`` minima are
   packed, bit plane by bit plane, into a few longs.
2. Equal word sequences are one class, represented by its smallest id.
3. The head of a bucket is its member whose buckets are the fullest: in a group of near copies the
   text that most of them come from. Every other member is paired with the head, so a bucket of g
   members gives g - 1 pairs. A pair is a candidate if the similarity estimated by counting equal bits,
   corrected for chance collisions, isn't far below the threshold, and a link if the full sets say so.
   Each member's likeliest head is tried first, the others if they are still in other components.
4. Members of a bucket that are not joined yet are compared with those of other components of the
   bucket, two chunks of it to a task, by estimate and then on full sets. So no pair of a bucket stays
   untested unless both are in one component already, where a link would change nothing. Pairs are ruled
   out by an exact bound first, from shingles that no other document of such buckets has, and by longer
   signatures; a task writes only the links that join what was apart in it, never the pairs it compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import blocks, give_back, id_and_text, stored, table
from tallyspark.llm.components import components

BANDS, ROWS = 32, 5
#: Minima whose low bits make the signature, and how many bits of each.
SIGNATURE, BITS = 192, 4
#: Minima of the longer signature with which the members of crowded buckets are compared.
LONG_SIGNATURE = 1024
#: Standard deviations of the estimate that a candidate may lie below the threshold.
SLACK = 4.5
#: Rows of a chunk of a crowded bucket, and shingles of its sets.
CHUNK_ROWS, CHUNK_SHINGLES = 1024, 1 << 20
WORDS_KEPT = 500_000

_ROUND = np.uint64(0x9E3779B97F4A7C15)
_SIGNATURE_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("n", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())),
])
_SET_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words (of fewer words: of them all; of none: empty)."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > WORDS_KEPT:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out * _ROUND) ^ h[k : len(h) - width + 1 + k]
        out ^= out >> np.uint64(32)
    return np.unique(mixed(out))


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _ROUND) | np.uint64(1)


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 256):  # what fits in the cache
        least = np.minimum(least, np.multiply.outer(factors, shingles[at : at + 256]).min(axis=1))
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64) * _ROUND
    for column in least[: bands * rows].reshape(bands, rows).T:
        out = mixed((out * _ROUND) ^ column)
    return out.view(np.int64)


def packed_bits(least: np.ndarray, bits: int) -> np.ndarray:
    """Plane by plane, the low bits of the (remixed) minima, 64 to a long."""
    low = mixed(least * _ROUND)
    planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in range(bits)]
    return np.concatenate(planes)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode().lower().split() if text else []


def signatures(df: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, class, n, bands, bits) of rows (doc_id, text); without words only doc_id and n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(max(BANDS * ROWS, SIGNATURE))
        for block in blocks(batches):
            classes, counts, bands, bits = [], [], [], []
            for text in block.column("text").to_pylist():
                words = words_of(text)
                s = shingle_set(words, shingle)
                counts.append(len(s))
                if not len(s):
                    classes.append(None)
                    bands.append(None)
                    bits.append(None)
                    continue
                classes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                least = minima(s, factors)
                bands.append(band_keys(least, BANDS, ROWS))
                bits.append(packed_bits(least[:SIGNATURE], BITS))
            columns = [block.column("doc_id").combine_chunks(), pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=_SIGNATURE_OUT.names)
        _words.clear()
        give_back()

    return df.mapInArrow(run, _SIGNATURE_OUT)


def sets(df: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles): the full set of each row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            found = [shingle_set(words_of(t), shingle).view(np.int64) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), pa.array(found, pa.list_(pa.int64()))], names=_SET_OUT.names)
        _words.clear()
        give_back()

    return df.mapInArrow(run, _SET_OUT)


def long_signatures(full: DataFrame) -> DataFrame:
    """(doc_id, shingles, bits): the sets of sets() with their longer signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(LONG_SIGNATURE)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                bits = [packed_bits(minima(np.asarray(s.values).view(np.uint64), factors), BITS) for s in part.column("shingles")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("shingles"), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "shingles", "bits"])

    return full.select("doc_id", "shingles").mapInArrow(run, "doc_id long, shingles array<long>, bits array<long>")


def estimate(a: Column, b: Column, length: int = SIGNATURE) -> Column:
    """Similarity from two packed signatures: the share of minima with all bits equal, less what
    chance gives."""
    per_plane = length // 64
    equal = F.lit(0)
    for k in range(per_plane):
        differ = F.lit(0).cast("long")
        for plane in range(BITS):
            at = plane * per_plane + k
            differ = differ.bitwiseOR(F.get(a, F.lit(at)).bitwiseXOR(F.get(b, F.lit(at))))
        equal = equal + (F.lit(64) - F.bit_count(differ))
    chance = 2.0**-BITS
    return (equal / F.lit(float(length)) - chance) / (1 - chance)


def slack(similarity: float, length: int = SIGNATURE) -> float:
    """How far below the threshold an estimate may lie."""
    chance = 2.0**-BITS
    p = similarity + (1 - similarity) * chance
    return SLACK * (p * (1 - p) / length) ** 0.5 / (1 - chance)


def met_in_buckets(open_: DataFrame, able: DataFrame, bands: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components within each bucket of ``open_`` (key, rep, component, main).

    The members of a bucket are dealt to chunks, by number and by size of their sets, and a task compares
    two chunks: sizes and the bound ``most`` of ``able`` first, then longer signatures, then full
    sets. It keeps only links between what was still apart there, fewer than it has rows, so what is written
    never grows with the pairs compared. A pair is compared in the first bucket that it shares.
    """
    found = open_.join(able, "rep")
    # a bucket in which every member left is in one component has nothing to join
    dealt = found.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    dealt = dealt.select("key", F.ceil(F.greatest(F.col("rows") / CHUNK_ROWS, F.col("shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    found = found.join(dealt, "key").withColumn("chunk", F.pmod(F.xxhash64("rep", "key"), F.col("chunks")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = found.select("key", "rep", "component", "main", "most", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    longer = long_signatures(full.join(able.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
    found = found.join(bands, "rep").join(longer.withColumnRenamed("doc_id", "rep"), "rep")

    def meet(rows: pa.Table) -> pa.Table:
        component = rows["component"].to_numpy().copy()
        pairs: list[tuple[int, int]] = []
        if (component != component[0]).any():
            rep, most, chunk, main = (rows[c].to_numpy() for c in ("rep", "most", "chunk", "main"))
            key, two = rows["key"][0].as_py(), rows["i"][0].as_py() != rows["j"][0].as_py()
            minor = component != main
            keys = np.asarray(pc.list_flatten(rows["bands"])).reshape(-1, BANDS)
            bits = np.asarray(pc.list_flatten(rows["bits"])).view(np.uint64).reshape(len(rep), BITS, -1)
            n = pc.list_value_length(rows["shingles"]).to_numpy().astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            shingles = np.asarray(pc.list_flatten(rows["shingles"])).view(np.uint64)
            sets_ = [shingles[ends[k] : ends[k + 1]] for k in range(len(rep))]
            chance = 2.0**-BITS
            least = percent / 100 - slack(percent / 100, LONG_SIGNATURE)
            for k in np.flatnonzero(minor):
                # each pair once: a minor with a main member, or with a minor of a larger id
                apart = (component != component[k]) & (~minor | (rep > rep[k]))
                if two:
                    apart &= chunk != chunk[k]
                common = np.minimum(most, most[k])
                at = np.flatnonzero(apart & (100 * common >= percent * (n + n[k] - common)))
                if not len(at):
                    continue
                differ = np.bitwise_or.reduce(bits[at] ^ bits[k], axis=1)
                equal = LONG_SIGNATURE - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
                alike = (equal / LONG_SIGNATURE - chance) / (1 - chance)
                near = alike >= least
                at, alike = at[near], alike[near]
                if not len(at):
                    continue
                same = keys[at] == keys[k]
                here = keys[k][same.argmax(axis=1)] == key
                at, alike = at[here], alike[here]
                for x in at[np.argsort(-alike, kind="stable")]:
                    if component[x] == component[k]:
                        continue
                    small, large = sorted((sets_[k], sets_[x]), key=len)
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[place] == small).sum())
                    if 100 * both >= percent * (len(small) + len(large) - both):
                        pairs.append((int(rep[k]), int(rep[x])))
                        component[component == component[x]] = component[k]
        return pa.table([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["a", "b"])

    return found.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(df: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``df``: documents whose sets of
    ``shingle``-word shingles have 100 * intersection >= ``percent`` * union are linked.

    Null and empty texts and texts without words have no shingles and link with nothing; nor do rows
    without an id, whose component is null. All of these are kept. Rows that share an id are one
    document, a row each in the result. Other columns of ``df`` are not read. An empty table gives
    no rows.
    """
    rows = id_and_text(df, id_col, text_col)
    marks = stored(signatures(rows, shingle))
    named = marks.where("doc_id IS NOT NULL AND class IS NOT NULL")
    classes = stored(named.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    members = classes.select("rep", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(members.join(sizes, "key"))  # only buckets of two and more
    fullness = shared.groupBy("rep").agg(F.sum("size").alias("fullness"))
    heads = shared.join(fullness, "rep").groupBy("key").agg(F.max_by("rep", F.struct("fullness", -F.col("rep"))).alias("head"))
    faces = classes.select("rep", "n", "bits")
    least = percent / 100 - slack(percent / 100)

    def faced(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(faces.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
        return pairs

    # pairs that can be links by the sizes of their sets and by the estimate
    possible = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    guess = estimate(F.col("bits_a"), F.col("bits_b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), by full sets."""
        a, b = (full.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"set_{s}")) for s in ("a", "b"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - F.col("common")
        return stored(pairs.join(a, "a").join(b, "b").withColumn("common", common).where(100 * F.col("common").cast("long") >= percent * union).select("a", "b").distinct())

    def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
        """The pairs (a, b) whose ends are in different components."""
        for side in ("a", "b"):
            pairs = pairs.join(joined.select(F.col("node").alias(side), F.col("component").alias(f"in_{side}")), side, "left")
        return pairs.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b")

    star = shared.join(heads, "key").where("rep != head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    star = stored(faced(star).select("a", "b", guess.alias("guess"), possible.alias("possible")).where(F.col("possible") & (F.col("guess") >= least)))
    best = stored(star.groupBy("b").agg(F.max_by("a", F.struct("guess", -F.col("a"))).alias("a")).select("a", "b"))
    # full sets of all documents that may be needed: one pass over the texts
    wanted = star.select(F.explode(F.array("a", "b")).alias("doc_id")).union(shared.where("size > 2").select("rep")).distinct()
    full = stored(sets(rows.join(wanted, "doc_id", "left_semi"), shingle))
    links = confirmed(best)
    joined = stored(components(links, "a", "b"))
    rest = stored(apart(star.select("a", "b").join(best, ["a", "b"], "left_anti"), joined))
    if not rest.isEmpty():
        links = links.union(confirmed(rest))
        joined = stored(components(links, "a", "b"))

    # members of a bucket outside its most frequent component meet those of the others
    placed = shared.where("size > 2").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("held"))
    largest = counts.groupBy("key").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    open_ = stored(placed.select("key", "rep", "component").join(largest, "key"))
    # shingles that no other document of these buckets has can't be common to two of them, so they
    # bound every similarity from above; in a group of copies with edits of their own they rule out most pairs
    who = open_.select("rep").distinct()
    mine = full.join(who.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode("shingles").alias("h")).distinct()
    private = mine.groupBy("h").agg(F.count("*").alias("held"), F.min("rep").alias("rep")).where("held = 1").groupBy("rep").agg(F.count("*").alias("private"))
    held = who.join(faces, "rep").groupBy("rep").agg(F.sum("n").alias("n"), F.min("n").alias("least"))  # a repeated id has several sets
    able = held.join(private, "rep", "left").withColumn("most", F.col("n") - F.coalesce("private", F.lit(0))).where(100 * F.col("most") >= percent * F.col("least"))
    able = stored(able.select("rep", "n", "most"))
    more = stored(met_in_buckets(open_, able, classes.select("rep", "bands"), full, percent))
    if not more.isEmpty():
        joined = components(links.union(more), "a", "b")

    found = classes.select("class", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    out = marks.select("doc_id", "class", F.col("n").alias("n_shingles")).join(found, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(df: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, but for documents linked with one of a smaller id."""
    gone = near_duplicates(df, percent, shingle, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return df.join(gone, df[id_col].cast("long") == F.col("_gone"), "left_anti")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir), percent=80, shingle=4)
