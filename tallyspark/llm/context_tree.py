"""Language-model scoring by context-tree weighting (operator 8).

The model is over bytes. A byte is eight binary decisions, so a context (the ``DEPTH`` bytes before,
and every shorter ending of them) has a binary node for each prefix of the next byte. Every node has a
Krichevsky-Trofimov estimate from the counts of training; context-tree weighting mixes the estimates of all
depths: a node's weighted probability is half its own estimate and half the product of its
children's (the contexts one byte longer), and the posterior weights follow from these. A context not
met in training takes what its longest known ending predicts. The code length of a byte is the sum of
those of its decisions.

A text is its words in order, a space after each, and an empty word at the end. Contexts are the bytes
before in this running text, across words; before its start stands the text's class: a number from
the text's most frequent short word, which mostly tells its language. The class is sent first, at
the cost of its own estimate, so the score is the probability of a whole code of the text. The work goes by
blocks of texts:

1. Each task cuts its texts into blocks, and writes for each block its texts, its distinct (context, byte) with
   counts of training, and for the unigram model its distinct words.
2. (context, byte) are summed over blocks by Spark.
3. The tree is weighted from the longest contexts up, and predictions go back down: below contexts of
   ``TOP`` bytes by subtrees, above by a grouping and a join for each depth. Contexts of held-out texts
   take part with count 0.
4. Scores of (context, byte) and words join the blocks that hold them, and each text's score is a sum over its bytes.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import blocks, crc32_of_id, give_back, id_and_text, stored, table

DEPTH = 5
#: Of texts; 0 is for those without a short word.
CLASSES = 16
FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 32 << 20
#: Depth down to which the tree's levels are tables, and rows of the subtrees weighted together.
TOP, PART_ROWS = 3, 100_000
#: How tables of sorted keys are stored: differences of neighbours, a few bytes each, instead of whole longs.
DELTAS = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}
#: Bytes of texts counted together, spread into contexts, and whose words are looked up at a time.
PART_BYTES, SPREAD_BYTES, WORDS_BYTES = 1 << 20, 256 << 10, 2 << 20
#: Counts below this take the logs of their estimates from a table.
SMALL = 4096

_LISTS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("class", T.IntegerType()),
    T.StructField("unit", T.BinaryType()), T.StructField("trained", T.LongType()),
    T.StructField("running", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()),
])


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space, with the end of the text as an empty word."""
    words = text.encode().lower().split() if text else []
    words.append(b"")
    return words


def class_of(count: Counter) -> int:
    """From the most frequent word of up to four ASCII letters (the last of those as frequent)."""
    most, short = 0, b""
    for w, n in count.items():
        if n >= most and len(w) <= 4 and w.isalpha() and (n > most or w > short):
            most, short = n, w
    return zlib.crc32(short) % CLASSES + 1 if most else 0


class KeyCounts:
    """The sorted keys (context, byte) of the texts added, with their counts in those learnt from."""

    def __init__(self):
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[tuple[bytes, bool]], depth: int) -> None:
        for learnt in (True, False):
            some = [x for x, t in texts if t == learnt]
            if some:
                key, n = np.unique(np.concatenate([_unit_keys(x, depth)[1] for x in _some(some, SPREAD_BYTES)]), return_counts=True)
                self._merge(key, n if learnt else np.zeros_like(n))

    def _merge(self, key: np.ndarray, n: np.ndarray) -> None:
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        within = at < len(self.key)
        known[within] = self.key[at[within]] == key[within]
        self.n[at[known]] += n[known]
        self.key, self.n = np.insert(self.key, at[~known], key[~known]), np.insert(self.n, at[~known], n[~known])


def block_lists(df: DataFrame, depth: int) -> DataFrame:
    """Rows of three kinds from (doc_id, text, held_out): for each text its class and running text; for
    each distinct word of a block (``unit``) its count in training texts; for each (context, byte) of a
    block, its key and its count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        empty = dict.fromkeys(_LISTS.names)

        def batch(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            types = {"block": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "class": pa.int32(), "unit": pa.binary(), "trained": pa.int64(), "running": pa.binary(), "key": pa.int64(), "n": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if columns.get(c) is None else pa.array(columns[c], t) for c, t in types.items()], names=list(empty))

        for k, part in enumerate(blocks(batches, BLOCK_BYTES, 1 << 30)):
            block = first + k
            trained: Counter[bytes] = Counter()
            docs = {c: [] for c in ("doc_id", "held_out", "n_tokens", "class", "running")}
            counts, some, size = KeyCounts(), [], 0
            for doc, held, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), part.column("text"), strict=True):
                words = words_of(text.as_py())
                count = Counter(words)
                kind = class_of(count)
                first_byte = bytes([kind])
                if held:
                    for w in count:
                        trained.setdefault(w, 0)
                else:
                    trained.update(words)
                for c, x in (("doc_id", doc), ("held_out", held), ("n_tokens", len(words)), ("class", kind), ("running", running := first_byte + b" ".join(words))):
                    docs[c].append(x)
                some.append((running, not held))
                size += len(running)
                if size >= PART_BYTES:
                    counts.add(some, depth)
                    some, size = [], 0
                if len(docs["doc_id"]) == 1000:
                    yield batch(block=[block] * 1000, **docs)
                    docs = {c: [] for c in docs}
            if docs["doc_id"]:
                yield batch(block=[block] * len(docs["doc_id"]), **docs)
            counts.add(some, depth)
            for at in range(0, len(counts.key), 200_000):
                key = counts.key[at : at + 200_000]
                yield batch(block=[block] * len(key), key=key, n=counts.n[at : at + 200_000])
            names = list(trained)
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield batch(block=[block] * len(some), unit=some, trained=[trained[w] for w in some])
        give_back()

    return df.mapInArrow(run, _LISTS)


def _some(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The texts in order, some of about ``most`` bytes at a time (one text may be larger)."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > most:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _unit_keys(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text (a byte for its class, and words), the space that ends it with it: the number of the text, and
    the context (the ``depth`` bytes before, the nearest lowest) and the byte, as a long. The class stands
    ``depth`` times before the text."""
    data = np.frombuffer(b"".join(w[:1] * depth + w[1:] + b" " for w in words), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + depth
    key = data.copy()
    for d in range(1, depth + 1):
        key[d:] |= data[:-d] << (8 * d)
    real = np.ones(len(data), bool)
    starts = np.cumsum(lengths) - lengths
    for d in range(depth):
        real[starts + d] = False
    return np.repeat(np.arange(len(words)), lengths - depth), key[real]


def log_gamma(x: Column) -> Column:
    """Of x >= 0.5, by Stirling's series eight higher."""
    y = x + F.lit(8.0)
    low = F.lit(1.0)
    for k in range(8):
        low = low * (x + F.lit(float(k)))
    series = F.lit(1.0) / (12 * y) - F.lit(1.0) / (360 * y * y * y) + F.lit(1.0) / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(low)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence with these counts."""
    z, o = zeros.cast("double"), ones.cast("double")
    return log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1.0) - F.lit(math.log(math.pi))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 0.5, by Stirling's series eight higher."""
    y, low = x + 8.0, np.ones_like(x)
    for k in range(8):
        low *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


@functools.cache
def _small_log_gammas(plus: float) -> np.ndarray:
    return _log_gamma(np.arange(SMALL) + plus)


def _log_gammas(n: np.ndarray, plus: float) -> np.ndarray:
    """Log gamma of whole numbers with ``plus`` added."""
    out = _small_log_gammas(plus)[np.minimum(n, SMALL - 1).astype(np.int64)]
    large = n >= SMALL
    if large.any():
        out[large] = _log_gamma(n[large] + plus)
    return out


def kt_logs(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence with these counts."""
    return _log_gammas(zeros, 0.5) + _log_gammas(ones, 0.5) - _log_gammas(zeros + ones, 1.0) - math.log(math.pi)


class Subtree:
    """The nodes of contexts of ``top`` to ``depth`` bytes above some (context, byte, n), where all rows
    of one context of ``top`` bytes are given. A node's key: its context times 256 and the bits before."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray, top: int, depth: int):
        self.top, self.depth = top, depth
        rows, times = (context.astype(np.int64) << 8) | byte, n.astype(np.float64)
        self.bit = ((byte.astype(np.int64)[:, None] >> (7 - np.arange(8))) & 1).astype(bool)
        #: from the longest contexts up: key, counts, log probabilities, and each node's parent in the next
        self.levels: list[list] = []
        for d in range(depth, top - 1, -1):
            # sorted (context, byte): the nodes before each bit are runs of them
            rows, place = np.unique(rows & ((1 << (8 * d + 8)) - 1), return_inverse=True)
            times = np.bincount(place, times, len(rows))
            keys, zeros, ones, node, starts = [], [], [], [], []
            at = 0
            for k in range(8):
                key = (rows >> 8 << 8) | (((rows & 255) + 256) >> (8 - k))
                first = np.append(True, key[1:] != key[:-1])
                run = np.cumsum(first) - 1
                one = (rows >> (7 - k)) & 1
                starts.append(np.flatnonzero(first))
                keys.append(key[starts[-1]])
                ones.append(np.bincount(run, times * one, len(keys[-1])))
                zeros.append(np.bincount(run, times * (1 - one), len(keys[-1])))
                node.append(run + at)
                at += len(keys[-1])
            key, zeros, ones = (np.concatenate(x) for x in (keys, zeros, ones))
            own = kt_logs(zeros, ones)
            if d == depth:
                self.leaf = np.stack([x[place] for x in node], axis=1)
                weighted = own
            else:
                parent = np.concatenate([x[place[s]] for x, s in zip(node, longer, strict=True)])
                self.levels[-1][5] = parent
                weighted = math.log(0.5) + np.logaddexp(own, np.bincount(parent, self.levels[-1][4], len(key)))
            longer = starts
            self.levels.append([key, zeros, ones, own, weighted, None])

    def top_nodes(self) -> dict[str, np.ndarray]:
        key, zeros, ones, own, weighted, _ = self.levels[-1]
        return {"context": key >> 8, "node": key & 255, "zeros": zeros, "ones": ones, "own": own, "weighted": weighted}

    def scores(self, total: np.ndarray, left: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Of each given (context, byte), its log probability. Given for each top node, in the order of
        keys: what shorter contexts add to the probability of a one, the weight they leave, and what
        they predict by themselves."""
        rank = np.argsort(np.argsort(self.levels[-1][0]))
        total, left, known = total[rank], left[rank], known[rank]
        for d, (_, zeros, ones, own, weighted, _) in zip(range(self.top, self.depth + 1), reversed(self.levels), strict=True):
            if d > self.top:
                parent = self.levels[self.depth - d][5]
                total, left, known = total[parent], left[parent], known[parent]
            seen = zeros + ones
            kt = (ones + 0.5) / (seen + 1.0)
            # a context without counts predicts what the shorter one does
            known = np.where(seen == 0, known, total + left * kt)
            if d < self.depth:
                stop = np.exp(math.log(0.5) + own - weighted)
                total, left = total + left * stop * kt, left * (1 - stop)
        one = known[self.leaf]
        return np.log(np.where(self.bit, one, 1 - one)).sum(axis=1)


def byte_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(context, byte, lp): the natural log probability of each byte after each context, from
    (context, byte, n) with the training count n, 0 for what only other texts hold.

    The subtrees below contexts of ``TOP`` bytes are weighted in tasks, some hundred thousand rows at a
    time; the levels above, a small share of the nodes, by a grouping and a join for each.
    """
    top = min(TOP, depth)
    counts = stored(counts, **DELTAS)
    parts = max(1, math.ceil(counts.count() / PART_ROWS))
    low = (1 << (8 * top)) - 1
    counts = counts.withColumn("part", F.pmod(F.xxhash64(F.col("context").bitwiseAND(low)), F.lit(parts)))

    def subtree(part: pd.DataFrame) -> Subtree:
        return Subtree(part["context"].to_numpy(), part["byte"].to_numpy(), part["n"].to_numpy(), top, depth)

    def weigh(part: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(subtree(part).top_nodes())
        give_back()
        return found

    def score(part: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        tops = tops.sort_values(["context", "node"])  # the order of the subtree's keys
        lp = subtree(part).scores(tops["sum"].to_numpy(), tops["left"].to_numpy(), tops["known"].to_numpy())
        give_back()
        return pd.DataFrame({"context": part["context"], "byte": part["byte"], "lp": lp})

    level = counts.groupBy("part").applyInPandas(weigh, "context long, node long, zeros double, ones double, own double, weighted double")
    half = math.log(0.5)
    levels = [stored(level)]
    for d in range(top - 1, -1, -1):
        shorter = F.col("context").bitwiseAND((1 << (8 * d)) - 1)
        level = levels[-1].groupBy(shorter.alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        level = level.withColumn("own", log_kt(F.col("zeros"), F.col("ones")))
        # the sum of two logs, the larger taken out
        high = F.greatest("own", "below")
        levels.append(stored(level.withColumn("weighted", high + F.log(F.exp(F.col("own") - high) + F.exp(F.col("below") - high)) + half)))
    above = None
    for d, level in zip(range(top + 1), reversed(levels), strict=True):
        if above is None:
            joined = level.withColumn("sum", F.lit(0.0)).withColumn("left", F.lit(1.0)).withColumn("known", F.lit(0.5))
        else:
            joined = level.withColumn("shorter", F.col("context").bitwiseAND((1 << (8 * (d - 1))) - 1)).join(above, ["shorter", "node"])
        if d < top:
            seen = F.col("zeros") + F.col("ones")
            kt, stop = (F.col("ones") + 0.5) / (seen + 1.0), F.exp(F.lit(half) + F.col("own") - F.col("weighted"))
            one = F.when(seen == 0, F.col("known")).otherwise(F.col("sum") + F.col("left") * kt)
            above = joined.select(F.col("context").alias("shorter"), "node", (F.col("sum") + F.col("left") * stop * kt).alias("sum"), (F.col("left") * (1 - stop)).alias("left"), one.alias("known"))
    tops = joined.select("context", "node", "sum", "left", "known", F.pmod(F.xxhash64("context"), F.lit(parts)).alias("its_part"))
    return counts.groupBy("part").cogroup(tops.groupBy("its_part")).applyInPandas(score, "context long, byte int, lp double")


def text_scores(texts: list[bytes], key: np.ndarray, lp: np.ndarray, depth: int) -> np.ndarray:
    """The natural log probability of each text, from those of the distinct keys (context, byte)."""
    place = pd.Index(key)
    found = [np.zeros(0)]
    for some in _some(texts, SPREAD_BYTES):
        owner, asked = _unit_keys(some, depth)
        found.append(np.bincount(owner, lp[place.get_indexer(asked)], len(some)))
    return np.concatenate(found)


_SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()),
])


def context_tree_scores(df: DataFrame, held_out: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``df``: the model's log10 probability of the text (``score``), its code length
    in bits per byte, and the score of a unigram model of words with half a count added
    (``base_score``). The rows with ``held_out`` false are learnt from.

    ``held_out`` is computed from the columns ``doc_id`` (long) and ``text``. A null or empty text is
    one token, the end. With nothing to learn from every decision has probability one half. Repeated
    rows and null ids are learnt from and scored like others; other columns of ``df`` are not read.
    An empty table gives no rows.
    """
    lists = stored(block_lists(id_and_text(df, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False))), depth), **DELTAS)
    listed = lists.where("unit IS NOT NULL").select("block", "unit", "trained")
    words = stored(listed.groupBy("unit").agg(F.sum("trained").alias("known")))
    tokens, distinct = words.agg(F.coalesce(F.sum("known"), F.lit(0)), F.count_if(F.col("known") > 0)).first()
    # for a word its count; for a (context, byte), without a word, its score
    values = listed.select("block", "unit").join(words, "unit").select(F.col("block").alias("its_block"), "unit", F.col("known").alias("key"), F.lit(0.0).alias("lp"))
    # each block asks once for every (context, byte) that its texts hold, and gets its score
    asked = lists.where("key IS NOT NULL").select("block", "key", "n")
    counted = asked.groupBy("key").agg(F.sum("n").alias("n")).select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), "n")
    scores = byte_scores(counted, depth).select(F.shiftleft("context", 8).bitwiseOR(F.col("byte").cast("long")).alias("key"), "lp")
    answers = asked.select("block", "key").join(scores, "key").select("block", F.lit(None).cast("binary"), "key", "lp")
    values = values.union(answers)
    docs = lists.where("running IS NOT NULL").select("block", "doc_id", "held_out", "n_tokens", "class", "running")
    # at most CLASSES + 1 rows
    texts = {r[0]: r[1] for r in docs.where("NOT held_out").groupBy("class").count().collect()}
    kinds = np.array([texts.get(k, 0) + 0.5 for k in range(CLASSES + 1)])
    kinds = np.log(kinds / kinds.sum())
    whole = tokens + 0.5 * (distinct + 1)

    def score(rows: pa.Table, own: pa.Table) -> pa.Table:
        asked = pc.is_null(own["unit"])
        mine = own.select(["key", "lp"]).filter(asked)
        running = rows["running"].to_pylist()
        totals = text_scores(running, mine["key"].to_numpy(), mine["lp"].to_numpy(), depth)
        del mine
        listed = own.select(["unit", "key"]).filter(pc.invert(asked)).combine_chunks()
        trained = listed["key"].to_numpy()
        base = np.log10((trained + 0.5) / whole)
        found, kind = [], iter(zip(rows["class"].to_pylist(), totals, strict=True))
        for some in _some(running, WORDS_BYTES):
            counts = [Counter([*text[1:].split(), b""]) for text in some]
            place = pc.index_in(pa.array([w for c in counts for w in c], pa.binary()), value_set=listed["unit"]).to_numpy()
            to = 0
            for text, count in zip(some, counts, strict=True):
                start, to = to, to + len(count)
                at, n = place[start:to], np.fromiter(count.values(), np.float64, len(count))
                its, total = next(kind)
                total = float(total) + kinds[its]
                found.append((int(n @ (trained[at] > 0)), float(n @ base[at]), total / math.log(10), -total / math.log(2) / len(text)))
        known, base_score, log10, bits = zip(*found, strict=True)
        columns = [pa.array(known, pa.int64()), pa.array([tokens] * len(known), pa.int64()), *(pa.array(c, pa.float64()) for c in (base_score, log10, bits))]
        del running, listed, found
        give_back()
        return pa.table([rows["doc_id"], rows["held_out"], rows["n_tokens"], *columns], names=_SCORES.names)

    return docs.groupBy("block").cogroup(values.groupBy("its_block")).applyInArrow(score, _SCORES)


def op8_context_tree(spark, sf_dir: str) -> DataFrame:
    return context_tree_scores(table(spark, sf_dir), crc32_of_id("doc_id") % FOLDS == HELD_OUT)
