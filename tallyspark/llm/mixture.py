"""Mixture-controlled packing by deficit round-robin over source queues (operator 11).

Each source is a queue of its documents' tokens in the order of a hash. Windows of ``CAPACITY`` tokens
are filled in turn: every queue's deficit grows by its share of the window, a queue whose deficit is
worth a piece is served that many tokens, and what a queue is still owed (or was served too early)
stays in its deficit for the next window.

Partitions fill blocks of windows side by side. What each queue has been served when a block begins
follows in closed form (:class:`Schedule`): token ``j`` of a queue with rate ``r`` is due at time
``(j + 0.5) / r``, and a block begins at the time when the tokens due before it fill all earlier
windows. A queue that runs dry just leaves its share to the others. The difference between the share
due and the tokens served is the deficit that the block starts with, so deficits are carried over
partitions too.

Texts are encoded once and their ids stored; the schedule works on narrow rows of lengths, and the
pieces meet the ids again by the number of their row.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.bpe import byte_characters
from tallyspark.llm.common import blocks, stored, table

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 1
#: A queue waits until it is owed so many tokens, so that shares of a few tokens don't shred documents.
MIN_PIECE = 256
#: Windows that one task fills at a time.
BLOCK_WINDOWS = 512
#: The sources with the most tokens have a queue each, all others share one (their totals are sent to every task).
MAX_QUEUES = 256
#: Documents of one queue are numbered in buckets of about so many tokens.
BUCKET_TOKENS = 8 << 20
#: Chunks of text kept in a Python worker between blocks, each of this many characters at most.
CACHED_CHUNKS, CACHED_CHARS = 400_000, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class ByteEncoder:
    """Ids of whole texts as the tokenizers library gives them for the file at ``path``, a byte-level
    vocabulary with the pattern of ``byte_bpe_50k``.

    A text of plain characters is cut into the matches of that pattern; any other text only before a
    blank or line end that a printing character follows, because no match of the pattern goes over that
    place. What was met before isn't encoded again. Where the file's merges stand in the order of the ids they make, ids follow
    from the tokens alone, and single matches are merged by tiktoken, which is faster; else, and for all
    chunks of other texts, by the library.
    """

    PLAIN = re.compile("[\t\n\r -~¡¿«»°´·À-ÿ]*")
    #: The pattern for plain characters.
    MATCHES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
    #: The ranges hold no white space.
    CUT = re.compile("(?=[ \n][!-~\u00a1-\u167f\u3001-\ud7ff])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(True) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        made = [vocab["".join(m) if not isinstance(m, str) else m.replace(" ", "")] for m in model["merges"]]
        self.merge = None
        if all(a < b for a, b in itertools.pairwise(made)) and all(c in byte_of for t in vocab for c in t):
            ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}
            self.merge = tiktoken.Encoding("bytes", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.matches: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _whole(self, chunks: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(chunks), 10_000):
            for found in self.library.encode_batch_fast(chunks[at : at + 10_000], add_special_tokens=False):
                yield found.ids

    def _encoded(self, split: list[list[str]], cache: dict[str, bytes], learn: Callable[[list[str]], Iterable[list[int]]]) -> list[bytes]:
        new = list(set().union(*split).difference(cache))
        code = "H" if self.kind.itemsize == 2 else "I"
        cache.update((chunk, array.array(code, ids).tobytes()) for chunk, ids in zip(new, learn(new), strict=True))
        out = [b"".join(map(cache.__getitem__, chunks)) for chunks in split]
        for chunk in new:
            if len(chunk) > CACHED_CHARS:
                del cache[chunk]
        if len(cache) > CACHED_CHUNKS:  # those met first are mostly the frequent ones
            kept = list(itertools.islice(cache.items(), CACHED_CHUNKS // 2))
            cache.clear()
            cache.update(kept)
        return out

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text (None: empty) in ``kind``."""
        whole = [bool(t) and any(s in t for s in self.special) for t in texts]
        plain = [not w and bool(self.PLAIN.fullmatch(t or "")) for t, w in zip(texts, whole, strict=True)]
        # a special token's string ends what the pattern sees, so such texts stay in one chunk
        other = iter(self._encoded([[t] if w else self.CUT.split(t) for t, w, p in zip(texts, whole, plain, strict=True) if not p], self.chunks, self._whole))
        merged = self._whole if self.merge is None else lambda new: (self.merge(x.encode()) for x in new)
        simple = iter(self._encoded([self.MATCHES.findall(t or "") for t, p in zip(texts, plain, strict=True) if p], self.matches, merged))
        return [next(simple if p else other) for p in plain]


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each Python worker."""
    return ByteEncoder(path)


class Schedule:
    """How many tokens of each queue stand before any place of the packed stream.

    ``sizes``: tokens of each queue; ``rates``: its weight in the mixture (above 0).
    """

    def __init__(self, sizes: list[int], rates: list[float], block_tokens: int):
        self.sizes = np.array(sizes, np.int64)
        self.rates = np.array(rates, np.float64)
        self.rates = self.rates / self.rates.sum() if len(sizes) else self.rates
        self.total, self.block_tokens = int(self.sizes.sum()), block_tokens
        self._known: dict[int, np.ndarray] = {}

    def due(self, time: np.ndarray) -> np.ndarray:
        """Tokens of each queue due up to each time."""
        return np.minimum(self.sizes, np.floor(time[:, None] * self.rates + 0.5).astype(np.int64))

    def times(self, place: np.ndarray) -> np.ndarray:
        """The latest time at which at most ``place`` tokens are due."""
        low = np.zeros(len(place))
        high = np.full(len(place), (self.sizes / self.rates).max() + 2 / self.rates.min())
        while True:
            mid = (low + high) / 2
            if ((mid <= low) | (mid >= high)).all():
                return low
            under = self.due(mid).sum(1) <= place
            low, high = np.where(under, mid, low), np.where(under, high, mid)

    def served(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each queue before each place (their sum is the place), and each queue's deficit there."""
        place = np.minimum(np.asarray(place, np.int64), self.total)
        time = self.times(place)
        now = self.due(time)
        # tokens due at the same moment go by the order of the queues
        then = np.where((place == self.total)[:, None], self.sizes, self.due(np.nextafter(time, np.inf)))
        more, more_before = then - now, np.cumsum(then - now, 1) - (then - now)
        out = now + np.clip((place - now.sum(1))[:, None] - more_before, 0, more)
        deficit = np.minimum(self.sizes, time[:, None] * self.rates) - out
        return out, deficit - deficit.mean(1, keepdims=True)

    def at_block(self, numbers: np.ndarray) -> np.ndarray:
        """Tokens of each queue before each of these blocks."""
        new = [b for b in np.unique(numbers).tolist() if b not in self._known]
        if new:
            if len(self._known) > 20_000:
                self._known = {}
                new = np.unique(numbers).tolist()
            self._known.update(zip(new, self.served(np.array(new, np.int64) * self.block_tokens)[0], strict=True))
        return np.array([self._known[b] for b in numbers.tolist()])

    def block_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The block in which token ``at`` of a queue lies."""
        block = self.due((at + 0.5) / self.rates[queue]).sum(1) // self.block_tokens
        block = np.clip(block, 0, max(0, (self.total - 1) // self.block_tokens))
        rows = np.arange(len(block))
        while True:
            early = at < self.at_block(block)[rows, queue]
            late = at >= self.at_block(block + 1)[rows, queue]
            if not (early | late).any():
                return block
            block = block - early + late


def fill_windows(pieces: list[list[tuple]], quota: np.ndarray, deficit: np.ndarray, rates: np.ndarray, capacity: int, least: int) -> Iterator[tuple]:
    """Deficit round-robin: (window, offset, queue, key, start, length) in order.

    ``pieces[q]``: (key, start, length) in the order of queue ``q``, ``quota[q]`` tokens in all. Queues
    that still hold tokens share each window by their ``rates``."""
    left, owed, rate = [int(x) for x in quota], [float(x) for x in deficit], [float(x) for x in rates]
    total = sum(left)
    heads = [iter(p) for p in pieces]
    head: list[tuple | None] = [next(h, None) for h in heads]
    k = len(left)
    for window in range(-(-total // capacity)):
        room = size = min(capacity, total - window * capacity)
        takes: dict[int, int] = {}
        held = [q for q in range(k) if left[q]]
        rated = sum(rate[q] for q in held)
        for q in held:
            owed[q] += size * rate[q] / rated
        for i in range(k):
            q = (window + i) % k
            take = min(int(owed[q]), left[q], room)
            if take > 0 and (take >= least or take == left[q]):
                takes[q] = take
                owed[q] -= take
                left[q] -= take
                room -= take
        while room:  # ahead of their shares: the queues that are owed most, no more than a piece each
            q = max((q for q in range(k) if left[q]), key=owed.__getitem__)
            take = min(left[q], room, least)
            takes[q] = takes.get(q, 0) + take
            owed[q] -= take
            left[q] -= take
            room -= take
        offset = 0
        for q, take in takes.items():
            while take:
                key, start, length = head[q]
                n = min(length, take)
                yield window, offset, q, key, start, n
                head[q] = (key, start + n, length - n) if n < length else next(heads[q], None)
                offset += n
                take -= n


def powers(n: int) -> list[int]:
    """Powers of two, the largest first, that add up to ``n``."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def encoded(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str | None) -> DataFrame:
    """(doc_id, row, queue, h, n, ids) of every row: ids with the end id, and a hash to order them by."""
    kind = byte_encoder(path).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], kind).tobytes()
        for block in blocks(batches, 8 << 20):
            ids = [raw + end for raw in byte_encoder(path).encode_texts(block.column("text").to_pylist())]
            n = pa.array([len(x) // kind.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*[block.column(c).combine_chunks() for c in ("doc_id", "row", "queue")], n, pa.array(ids, pa.binary())], names=["doc_id", "row", "queue", "n", "ids"])

    # "" is the queue of null sources
    queue = F.coalesce(F.concat(F.lit("s"), df[source_col].cast("string")), F.lit("")) if source_col else F.lit("")
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), queue.alias("queue"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id long, row long, queue string, n long, ids binary").withColumn("h", F.xxhash64("doc_id", "row"))


def queue_starts(docs: DataFrame, total: int) -> DataFrame:
    """``docs`` (doc_id, row, queue, h, n) with ``at``, the tokens of its queue before each document.

    Buckets of a queue are summed first, so that no task sees a whole queue."""
    parts = max(1, -(-total // (256 * BUCKET_TOKENS)))
    docs = docs.withColumn("coarse", F.pmod("h", F.lit(256))).withColumn("fine", F.pmod(F.shiftrightunsigned("h", 8), F.lit(parts)))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    fine = docs.groupBy("queue", "coarse", "fine").agg(F.sum("n").alias("n"))
    coarse = fine.groupBy("queue", "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.select("queue", "coarse", F.coalesce(F.sum("n").over(before("queue").orderBy("coarse")), F.lit(0)).alias("at_coarse"))
    fine = fine.select("queue", "coarse", "fine", F.coalesce(F.sum("n").over(before("queue", "coarse").orderBy("fine")), F.lit(0)).alias("at_fine"))
    starts = fine.join(coarse, ["queue", "coarse"]).withColumn("at_bucket", F.col("at_fine") + F.col("at_coarse"))
    inside = F.coalesce(F.sum("n").over(before("queue", "coarse", "fine").orderBy("h", "row")), F.lit(0))
    docs = docs.withColumn("at", inside).join(starts.select("queue", "coarse", "fine", "at_bucket"), ["queue", "coarse", "fine"])
    return docs.select("doc_id", "row", "queue", "n", (F.col("at") + F.col("at_bucket")).alias("at"))


def _queue_number(names: list[str]) -> Column:
    """The place of a queue in ``names``; all others follow as one."""
    numbers = F.create_map(*itertools.chain.from_iterable((F.lit(n), F.lit(i)) for i, n in enumerate(names))) if names else None
    return F.coalesce(F.try_element_at(numbers, F.col("queue")), F.lit(len(names))) if names else F.lit(0)


_PLACED = "row long, queue int, start long, length long, sequence_id long, offset long"
_OUT = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_mixture(
    df: DataFrame, weights: Mapping[str | None, float] | None = None, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, min_piece: int = MIN_PIECE,
    block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue): every token of every row
    of ``df`` in exactly one piece.

    ``weights`` gives the mixture by source (a source not named weighs 1; all above 0); by default each source weighs
    what it holds, so that every window has the mixture of the whole table. Named sources and those with
    the most tokens have queues of their own, up to ``max_queues``; all others share one, which weighs as
    they do together. All windows are full but the last, which is cut into sequences of powers of two; so
    nothing is padded.

    A null or empty text is its end id. Null sources are a queue of their own. Repeated rows and null ids are packed like others,
    told apart by ``row``; other columns of ``df`` are not read. An empty table gives no rows.
    """
    path = path or default_vocabulary()
    ids = stored(encoded(df, path, end_id, id_col, text_col, source_col), compression="zstd")
    sums = ids.groupBy("queue").agg(F.sum("n").alias("n"))
    total, count = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    weigh = {("" if s is None else f"s{s}"): float(w) for s, w in (weights or {}).items()}
    if len(weigh) >= max_queues or min(weigh.values(), default=1) <= 0:
        raise ValueError(f"weights: fewer than {max_queues} sources, all above 0")
    top = sums.orderBy(F.col("queue").isin(list(weigh)).desc(), F.desc("n"), "queue").limit(max_queues if count <= max_queues else max_queues - 1).collect()
    names, sizes = [r["queue"] for r in top], [r["n"] for r in top]
    rates = [float(n) if weights is None else weigh.get(q, 1.0) for q, n in zip(names, sizes, strict=True)]
    if count > len(names):
        sizes.append(total - sum(sizes))
        rates.append(float(sizes[-1] if weights is None else count - len(names)))
    plan = Schedule(sizes, rates, capacity * block_windows)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queue, at, n, row = (batch.column(c).to_numpy() for c in ("queue", "at", "n", "row"))
            if not len(row):
                continue
            first, last = plan.block_of(queue, at), plan.block_of(queue, at + n - 1)
            times = last - first + 1
            i = np.repeat(np.arange(len(row)), times)
            block = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            rows = np.arange(len(i))
            begin = np.maximum(at[i], plan.at_block(block)[rows, queue[i]])
            stop = np.minimum((at + n)[i], plan.at_block(block + 1)[rows, queue[i]])
            some = stop > begin
            i, block, begin, stop = i[some], block[some], begin[some], stop[some]
            out = [block, queue[i], begin, row[i], begin - at[i], stop - begin]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["block", "queue", "at", "row", "start", "length"])

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        (begin, stop), deficit = plan.served(np.array([block, block + 1]) * plan.block_tokens)
        rows = rows.sort_values(["queue", "at"], ignore_index=True)
        queues: list[list[tuple]] = [[] for _ in sizes]
        for q, *piece in zip(rows["queue"].tolist(), rows["row"].tolist(), rows["start"].tolist(), rows["length"].tolist(), strict=True):
            queues[q].append(tuple(piece))
        held = int((stop - begin).sum())
        tail = held % capacity  # only the last block has one
        edges = list(itertools.accumulate(powers(tail), initial=0))
        out = []
        for window, offset, q, row, start, n in fill_windows(queues, stop - begin, deficit[0], plan.rates, capacity, min_piece):
            number = block * block_windows + window
            if window < held // capacity:
                out.append((row, q, start, n, number, offset))
                continue
            for k, (a, b) in enumerate(itertools.pairwise(edges)):
                x, y = max(a, offset), min(b, offset + n)
                if x < y:
                    out.append((row, q, start + x - offset, y - x, number + k, x - a))
        return pd.DataFrame(out, columns=["row", "queue", "start", "length", "sequence_id", "offset"])

    lengths = ids.select("doc_id", "row", _queue_number(names).alias("queue"), "h", "n")
    starts = queue_starts(lengths, total)
    blocked = starts.select("queue", "at", "n", "row").mapInArrow(to_blocks, "block long, queue int, at long, row long, start long, length long")
    placed = blocked.groupBy("block").applyInPandas(fill, _PLACED)
    kind = byte_encoder(path).kind

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, row, raw, pieces in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "ids", "pieces")), strict=True):
                wide = memoryview(np.frombuffer(raw, kind).astype("<u4").tobytes())
                rows += [(doc, row, p["start"], p["length"], zlib.crc32(wide[p["start"] * 4 : (p["start"] + p["length"]) * 4]), len(wide) // 4, p["sequence_id"], p["offset"]) for p in pieces]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_OUT.names)

    pieces = placed.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    return ids.select("doc_id", "row", "ids").join(pieces, "row").select("doc_id", "row", "ids", "pieces").mapInArrow(digests, _OUT)


def op11_mixture_packing(spark, sf_dir: str) -> DataFrame:
    return pack_mixture(table(spark, sf_dir)).drop("row")
