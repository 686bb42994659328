"""Target-distribution importance resampling over an Aho-Corasick dictionary (operator 12).

Texts are cut into words, and the distinct words of a block of texts, each between two delimiters, are
the patterns of one automaton. A word's payload is its CRC and its length in bytes. A scan of a text
emits the payloads of its words in order; the CRC of a run of adjacent words follows from their payloads
alone, since the CRC of ``a + b`` is a linear map of that of ``a``, applied once for each byte of ``b``,
xor that of ``b``. CRCs modulo the number of buckets are the features.

Bucket counts are summed within each block before they are shuffled. A bucket's gain, the log ratio of
its share in the target to that in the documents, weighs the documents; Gumbel noise from a hash of
the id turns the weights into a draw without replacement: the highest sums win.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import blocks, id_and_text, stored, table
from tallyspark.operators.skew import rank_in_ranges

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Each feature counts by a power of two of the bytes behind it; words are shorter than 2^40 bytes.
_POWERS = 40

#: A-Z to lower case, other ASCII characters but digits and a-z to a space; all bytes of other characters stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _byte_map() -> list[np.ndarray]:
    """What one zero byte makes of a CRC register, as four tables by the register's bytes; then two zero bytes, four, and so on."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    apply = lambda t, c: t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    low = np.arange(256, dtype=np.uint32)
    maps = [np.stack([one, *[low << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]])]
    for _ in range(_POWERS - 1):
        maps.append(np.stack([apply(maps[-1], apply(maps[-1], low << np.uint32(8 * k))) for k in range(4)]))
    return maps


_MAPS = _byte_map()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of ``a + b`` from those of ``a`` and ``b`` and the lengths of ``b`` in bytes."""
    out = first.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        t = _MAPS[k]
        moved = t[0][out & 255] ^ t[1][out >> 8 & 255] ^ t[2][out >> 16 & 255] ^ t[3][out >> 24]
        out = np.where(length >> k & 1, moved, out)
    return out ^ second.astype(np.uint32)


class Dictionary:
    """An automaton over the words of some texts. Words hold no blank, so the one pattern that ends at a
    blank is the word before it, and no word is found inside another."""

    def __init__(self, words: set[str]):
        import ahocorasick

        self.crc, self.length = np.empty(len(words), np.uint32), np.empty(len(words), np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            raw = word.encode()
            self.crc[i], self.length[i] = zlib.crc32(raw), len(raw)
            self.automaton.add_word(f" {word} ", i)
        self.automaton.make_automaton()

    def payloads(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of each of the ``n`` words of a text in which single blanks stand around words."""
        at = np.fromiter((i for _, i in self.automaton.iter(text)), np.int64, n)
        return self.crc[at], self.length[at]


def features(crc: np.ndarray, length: np.ndarray, longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` adjacent words, joined by one blank."""
    out, run = [crc], crc
    blank = np.uint32(zlib.crc32(b" "))
    for n in range(2, min(longest, len(crc)) + 1):
        before = joined_crc(run[:-1], np.broadcast_to(blank, len(run) - 1), np.ones(len(run) - 1, np.int64))
        run = joined_crc(before, crc[n - 1 :], length[n - 1 :])
        out.append(run)
    return np.concatenate(out).astype(np.int64) % buckets


def texts_features(texts: list[str | None], longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the buckets of each text."""
    plain = [b" ".join(t.encode().translate(_WORD_BYTES).split()).decode() if t else "" for t in texts]
    split = [t.split(" ") if t else [] for t in plain]
    known = Dictionary(set().union(*split)) if any(plain) else None
    for text, words in zip(plain, split, strict=True):
        if words:
            yield len(words), features(*known.payloads(f" {text} ", len(words)), longest, buckets)
        else:
            yield 0, np.zeros(0, np.int64)


def bucket_counts(df: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How often each bucket is met in all texts of ``df`` (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for block in blocks(batches, 4 << 20):
            for _, found in texts_features(block.column("text").to_pylist(), longest, buckets):
                counts += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    rows = df.select(df[text_col].cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, every count one higher."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the hash of the seed and the id (null: no digits)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weights(df: DataFrame, gain: np.ndarray, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each text's features (none: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            rows = [(n, len(f), int(gain[f].sum()) // len(f) if n else 0) for n, f in texts_features(block.column("text").to_pylist(), longest, len(gain))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], names=["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    df: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): a draw of ``percent`` of the rows of at least
    ``least_words`` words, likelier the more their words are those of ``target``. ``rank`` is 1, 2, 3 ... by
    score, null where a row isn't drawn.

    Null and empty texts have no features, weight 0 and are never drawn (for ``least_words`` of 1 or more).
    Repeated rows count each; rows of one id have one noise, and those that tie in score and id are
    ranked in any order. Null ids share the noise of no digits and come last among equals. An empty table gives no rows; an
    empty target has the same share in every bucket. Other columns aren't read.
    """
    gain = gains(bucket_counts(df, longest, buckets, text_col), bucket_counts(target, longest, buckets, target_text))
    rows = stored(weights(df, gain, longest, id_col, text_col))  # the range sort below reads its input twice
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("short", F.col("n_words") < least_words)
    # ranked in ranges of (short, score, id), so neither a score nor the whole order goes to one task; short rows come last
    ranked = rank_in_ranges(rows, [], [F.col("short").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    n = ranked.where(~F.col("short")).count()
    drawn = ~F.col("short") & (F.col("rank") <= percent * n // 100)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("n_words")


#: The table of the CRC is made by its rule; each distinct word's bytes are then folded in.
ORACLE_SQL = r"""
WITH crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
cut AS (
  SELECT 0 AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
met AS (SELECT side, id, unnest(w) AS word FROM cut),
words AS (SELECT DISTINCT word, hex(encode(word)) AS hx FROM met),
crcs AS (SELECT word, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(hx) // 2), lambda i: CAST('0x' || hx[2 * i + 1:2 * i + 2] AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS BIGINT) AS bucket FROM words, crc_table),
counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM met JOIN crcs USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS ns, sum(t) AS nt FROM counted),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(ns + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(nt + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM counted, totals),
weighed AS (SELECT id, count(*) AS n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM met JOIN crcs USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || CAST(id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM cut LEFT JOIN weighed USING (id) WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
