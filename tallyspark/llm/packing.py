"""Best-fit packing of token sequences with a bounded set of open bins (operator 5).

Texts are encoded where they lie; only one small row for each piece is shuffled, into blocks of
about ``BLOCK_SEQUENCES`` full sequences. Within a block pieces arrive in the order of a hash of
their document. The open bins are kept by free space, and a bitset has a bit for each free space
of which some bin is open: the lowest set bit at or above a piece's length is the best fit. If
none fits, a bin is opened, and if more than ``OPEN_BINS`` are open, the fullest is closed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.bpe import default_vocabulary, encoder
from tallyspark.llm.common import blocks, give_back, id_and_text, stored, table

CAPACITY = 2048
OPEN_BINS = 1024
#: A block leaves a few part-filled sequences, so it should fill many.
BLOCK_SEQUENCES = 16_384
END_ID = 0

_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


class OpenBins:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.opened = 0

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the place in it where a piece of ``length`` (1 to the capacity) goes."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:  # a full bin is closed at once
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free


def token_pieces(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): the ids of each text and ``end_id``, cut every
    ``capacity`` tokens. ``row`` tells apart rows of one id."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, cut = end_id.to_bytes(4, "little"), capacity * 4
        for block in blocks(batches, 8 << 20):
            rows = []
            keys = zip(block.column("doc_id").to_pylist(), block.column("row").to_pylist(), strict=True)
            for (doc, row), raw in zip(keys, encoder(path).encode_texts(block.column("text").to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), cut)):
                    part = raw[at : at + cut]
                    rows.append((doc, row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_PIECES.names)
        give_back()

    return id_and_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, block_sequences: int = BLOCK_SEQUENCES) -> DataFrame:
    """``pieces`` (doc_id, row, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    The number of blocks follows from the sum of all lengths. Ids of sequences are a block's number
    times 2^32 and up, so any two blocks have different ones.
    """
    pieces = stored(pieces)
    total = pieces.agg(F.sum("length")).first()[0] or 0
    n = max(1, math.ceil(total / (capacity * block_sequences)))
    # rows of one document may go to different blocks; null ids are spread by their row
    dealt = pieces.withColumn("_order", F.xxhash64("doc_id", "row", "piece")).withColumn("_block", F.pmod("_order", F.lit(n)))
    out = T.StructType([*_PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        bins, first = OpenBins(capacity, open_bins), int(key[0]) << 32
        block = block.sort_values(["_order", "doc_id", "row", "piece"], ignore_index=True)
        places = [bins.put(x) for x in block["length"].tolist()]
        block["sequence_id"] = [first + b for b, _ in places]
        block["offset"] = [o for _, o in places]
        return block[out.names]

    return dealt.groupBy("_block").applyInPandas(fill, out)


def pack_documents(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as one or more pieces in sequences of at most ``capacity`` tokens.

    A null or empty text is one piece: the end id. Repeated rows and null ids are packed like
    others, a piece or more for each row; other columns of ``df`` are not read. An empty table gives
    no rows.
    """
    return pack(token_pieces(df, path, capacity, END_ID, id_col, text_col), capacity, open_bins)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir)).drop("row")
