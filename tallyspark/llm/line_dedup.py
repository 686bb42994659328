"""Line dedup by pairwise alignment (operator 7).

Lines are hashed. Lines that stand in one document only drop out at once. Of the others, the shortest
runs of consecutive lines that reach ``min_words`` are taken, from each line forward and from each line
back; a run pairs each document that holds it with the first one that does, so that a run of g
documents gives g - 1 pairs however frequent it is. Every line of a repeated block lies in such a run within the
block, so no other pairs are needed. The shared lines of the two documents of
a pair are aligned by patience diff: lines that stand once in either are anchors, the longest rising
run of anchors is kept, and the gaps between are aligned in turn. Aligned lines that follow one
another in both documents are a block; blocks of ``min_words`` words and more are deleted from the
later document. What the first pass leaves is aligned again, so that blocks in another order are
found too; last, the runs of lines that reach ``min_words`` are looked up among those of the other document, so
that a block is found whichever copies of its lines were aligned. The first holder of a run never loses
it for that run.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import SPACES, stored, table

MIN_WORDS = 50


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first entries, in which the second rise too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def anchors(a: Sequence[int], b: Sequence[int], i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """Places of the lines that are rarest in the two ranges: those that stand once in either, or
    else those with the fewest copies, first with first, second with second, and so on."""
    left, right = Counter(a[i0:i1]), Counter(b[j0:j1])
    common = {x: max(n, right[x]) for x, n in left.items() if x in right}
    if not common:
        return []
    fewest = min(common.values())
    at: dict[int, list[int]] = {x: [] for x, n in common.items() if n == fewest}
    for j in range(j0, j1):
        if b[j] in at:
            at[b[j]].append(j)
    used: Counter = Counter()
    pairs = []
    for i in range(i0, i1):
        if (places := at.get(a[i])) is not None and used[a[i]] < len(places):
            pairs.append((i, places[used[a[i]]]))
            used[a[i]] += 1
    return rising(pairs)


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences of line hashes, in rising order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        found = anchors(a, b, i0, i1, j0, j1)
        if not found:
            continue
        todo.append((i0, found[0][0], j0, found[0][1]))
        for (i, j), (i2, j2) in zip(found, [*found[1:], (i1, j1)], strict=True):
            out.append((i, j))
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(out)


def runs(seq: Sequence[tuple], min_words: int) -> list[tuple[int, int]]:
    """Bounds in ``seq`` (its entries as in ``repeated_lines``) of the shortest runs of consecutive lines
    that reach ``min_words`` words, from each line forward and from each line back. Every line of a block of
    so many words lies in a run within the block: its own, or the one back from the block's end."""
    found: set[tuple[int, int]] = set()
    at = 0
    while at < len(seq):
        end = at + 1
        while end < len(seq) and seq[end][0] == seq[end - 1][0] + 1:
            end += 1
        words = [0, *accumulate(x[3] for x in seq[at:end])]
        for k in range(end - at):
            if (to := bisect_left(words, max(words[k] + min_words, words[k + 1]))) < len(words):
                found.add((at + k, at + to))
            if words[k + 1] >= min_words:
                found.add((at + min(k, bisect_right(words, words[k + 1] - min_words) - 1), at + k + 1))
        at = end
    return sorted(found)


def repeated_lines(first: Sequence[tuple], later: Sequence[tuple], min_words: int) -> list[int]:
    """Places in the later document of the lines to delete. The entries of both: (number among the
    document's lines that aren't blank, place, hash, words), in order."""
    gone: list[int] = []
    whole = later
    while first and later:
        pairs = patience([x[2] for x in first], [x[2] for x in later])
        deleted: set[int] = set()
        block: list[int] = []
        last = None
        for i, j in [*pairs, (None, None)]:
            here = None if i is None else (first[i][0], later[j][0])
            if block and (here is None or here != (last[0] + 1, last[1] + 1)):
                if sum(later[k][3] for k in block) >= min_words:
                    deleted.update(block)
                block = []
            if here is not None:
                block.append(j)
                last = here
        if not deleted:
            break
        # what is deleted is done with in the later document; the first may repeat in it
        gone += [later[j][1] for j in sorted(deleted)]
        later = [x for j, x in enumerate(later) if j not in deleted]
    if later:
        # an alignment takes each line to one copy; what it leaves is looked up among all runs of the first
        known = {tuple(x[2] for x in first[a:b]) for a, b in runs(first, min_words)}
        more = {x[1] for a, b in runs(whole, min_words) if tuple(x[2] for x in whole[a:b]) in known for x in whole[a:b]}
        gone += sorted(more.difference(gone))
    return gone


_KEY = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
_RUNS = T.StructType([*_KEY, T.StructField("run", T.BinaryType())])
_GONE = T.StructType([*_KEY, T.StructField("gone", T.ArrayType(T.IntegerType()))])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with the order of documents: by id, then by a hash of the text (null ids last)."""
    return df.withColumn("k1", F.coalesce(df[id_col].cast("long"), F.lit((1 << 63) - 1))).withColumn("k2", F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))))


def lines_to_delete(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, gone): for documents (k1, k2, text) with lines to delete, the lines' places from 0."""
    numbered = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: F.btrim(x["line"], F.lit(SPACES)) != "")
    lines = df.select("k1", "k2", F.posexplode(numbered).alias("number", "x")).select(
        "k1", "k2", "number", "x.pos", F.xxhash64("x.line").alias("h"), F.hash("x.line").alias("h2"), F.regexp_count("x.line", F.lit(r"[^ \t\n\x0B\f\r]+")).alias("words")
    )
    lines = stored(lines)
    doc = F.struct("k1", "k2")
    shared = lines.groupBy("h", "h2").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).where("first != last").select("h", "h2")
    held = lines.join(shared, ["h", "h2"]).select("k1", "k2", "number", "pos", "h", "words")
    texts = stored(held.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("number", "pos", "h", "words"))).alias("seq")))

    def entries(column: pa.Array) -> Iterator[list[tuple]]:
        flat = column.flatten()
        rows = list(zip(*(flat.field(n).to_pylist() for n in ("number", "pos", "h", "words")), strict=True))
        at = 0
        for n in column.value_lengths().to_pylist():
            yield rows[at : at + n]
            at += n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                owner, keys = [], []
                for k, seq in enumerate(entries(part.column("seq"))):
                    hashes = np.array([x[2] for x in seq], "<i8")
                    found = {blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in runs(seq, min_words)}
                    keys += found
                    owner += [k] * len(found)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(owner, pa.int64())) for c in ("k1", "k2")), pa.array(keys, pa.binary())], names=_RUNS.names)

    held = stored(texts.mapInArrow(cut, _RUNS))
    firsts = held.groupBy("run").agg(F.min(doc).alias("first"), F.max(doc).alias("last")).where("first != last").select("run", "first")
    pairs = held.join(firsts, "run").where((F.col("first.k1") != F.col("k1")) | (F.col("first.k2") != F.col("k2"))).select("k1", "k2", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")).distinct()
    both = pairs.join(texts, ["k1", "k2"]).join(texts.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("seq").alias("first_seq")), ["f1", "f2"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                gone = [repeated_lines(f, s, min_words) for f, s in zip(entries(part.column("first_seq")), entries(part.column("seq")), strict=True)]
                hit = [k for k, g in enumerate(gone) if g]
                keys = [part.column(c).take(pa.array(hit, pa.int64())) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([gone[k] for k in hit], pa.list_(pa.int32()))], names=_GONE.names)

    found = both.select("k1", "k2", "seq", "first_seq").mapInArrow(align, _GONE)
    return found.select("k1", "k2", F.explode("gone").alias("pos")).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _applied(df: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, list[str], str]:
    hidden = [f"_in{k}" for k in range(len(df.columns))]  # whatever the columns are called
    i, t = (hidden[df.columns.index(c)] for c in (id_col, text_col))
    rows = _keyed(df.toDF(*hidden), i, t)
    gone = lines_to_delete(rows.select("k1", "k2", F.col(t).cast("string").alias("text")), min_words)
    left = F.when(F.col("gone").isNull(), F.col(t)).otherwise(F.array_join(F.filter(F.split(F.col(t), "\n"), lambda x, k: ~F.array_contains("gone", k)), "\n"))
    return rows.join(gone, ["k1", "k2"], "left").withColumn("_left", left), hidden, t


def line_dedup(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``, all rows and columns, with repeated blocks deleted from the texts.

    Documents are ordered by id, then by a hash of the text; null ids come last. Repeated rows of one
    id and text are one document and stay alike. Null and empty texts stay as they are; a text all
    of whose lines are deleted becomes empty. An empty table gives no rows.
    """
    rows, hidden, t = _applied(df, id_col, text_col, min_words)
    return rows.select(*[F.col("_left").alias(c) if c == t else F.col(c) for c in hidden]).toDF(*df.columns)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Of each document the lines and deleted lines, their places, and a digest of the text left."""
    rows, hidden, t = _applied(table(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", MIN_WORDS)
    text = F.coalesce(F.col("_left"), F.lit(""))
    return rows.select(
        F.col(hidden[0]).alias("doc_id"), F.size(F.split(F.coalesce(F.col(t), F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("deleted"),
        F.char_length(text).cast("long").alias("chars_left"), F.crc32(text.cast("binary")).alias("left_crc32"),
    )
