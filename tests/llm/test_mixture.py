"""Mixture-controlled packing against the tokenizers library, its laws and a schedule computed token by token."""

import functools
import struct
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixture

SF = "/root/testdata/sf0.001"


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(mixture.default_vocabulary())


def check_pieces(texts, rows, capacity=2048, end_id=1):
    """All pieces of every (key, text) together are its ids and the end, and each sequence has no gap.
    Returns the tokens of padding."""
    ids = {k: library().encode(t or "", add_special_tokens=False).ids + [end_id] for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for key, start, length, crc, tokens, sequence, offset in rows:
        assert length > 0 and tokens == len(ids[key])
        assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[key][start : start + length]))
        by_doc[key].append((start, length))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(pieces)) and sum(pieces[-1]) == len(ids[key])
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(pieces))
        size = sum(pieces[-1])
        assert size <= capacity
        padding += 0 if size & (size - 1) == 0 else capacity - size
    return padding


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = mixture.op11_mixture_packing(spark, SF)
    rows = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in out.collect()]
    assert check_pieces(texts, rows) == 0


def test_chunks_give_the_ids_of_whole_texts():
    texts = ["a  b\n\nc", " x", "x ", "\n\n y\n", "é à\n  z \t\n k", "<|endoftext|> a\n\n<|endoftext|>b", "don't  we'll\r\n 12 3", "\x85\x85 a\xa0 b", "日本 語\n\n本", "a" * 3000 + " " * 50 + "b", "😀 😀\n😀", "", None]
    coder = mixture.ByteEncoder(mixture.default_vocabulary())
    for _ in range(2):  # the second time out of the cache
        found = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode_texts(texts)]
        assert found == [library().encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("rates", [[5, 3, 2, 1], [1, 1, 1, 1], [100, 1, 1e-3, 7]])
def test_schedule_is_the_order_of_due_times(rates):
    sizes = [500, 30, 1, 271]
    plan = mixture.Schedule(sizes, rates, 64)
    share = np.array(rates) / sum(rates)
    order = sorted(((j + 0.5) / share[q], q) for q, n in enumerate(sizes) for j in range(n))
    for place in range(len(order) + 1):
        served = plan.served(np.array([place]))[0][0]
        assert served.sum() == place
    for b in range(len(order) // 64 + 2):
        before = [q for _, q in order[: b * 64]]
        assert np.abs(plan.at_block(np.array([b]))[0] - np.bincount(before, minlength=4)).max() <= 1  # rounding of equal times
    for q, n in enumerate(sizes):
        at = np.arange(n)
        block = plan.block_of(np.full(n, q), at)
        assert (np.diff(block) >= 0).all()
        assert (plan.at_block(block)[at, q] <= at).all() and (at < plan.at_block(block + 1)[at, q]).all()


def test_deficits_bound_the_mixture():
    """After every window no queue is further from its share than a piece it waits for and a window's topping up."""
    rng = np.random.default_rng(7)
    quota = rng.integers(5_000, 200_000, 9)
    pieces = [[(q, 0, int(n))] for q, n in enumerate(quota)]
    served, last, total = np.zeros(9), -1, quota.sum()
    for window, offset, q, _, _, n in mixture.fill_windows(pieces, quota, np.zeros(9), quota, 2048, 256):
        if window != last:
            assert np.abs(served - served.sum() * quota / total).max() <= 256 + 256
            last = window
        assert offset < 2048
        served[q] += n
    assert (served == quota).all()


@pytest.mark.parametrize("block_windows", [1, 3])
def test_blocks_carry_deficits(spark, block_windows):
    """Small windows over many blocks, one source with a third of the tokens, null ids, sources and texts."""
    docs = [(i, "a quick brown fox " * (i % 37), "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(300)] + [(None, None, None), (None, "no id", ""), (7, "twice", "hot"), (7, "twice", "hot")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("row", F.lit("x")).withColumn("queue", F.lit(1)).withColumn("h", F.lit(2)).repartition(5).cache()
    out = mixture.pack_mixture(df, capacity=128, min_piece=8, block_windows=block_windows).collect()
    keyed = defaultdict(list)
    for r in out:
        keyed[r.row].append(r)
    assert len(keyed) == len(docs)
    rows = [(r.row, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in out]
    left, texts = sorted(docs, key=str), {}
    encode = library()
    for row, pieces in keyed.items():
        doc, tokens = pieces[0].doc_id, pieces[0].doc_tokens
        found = next(d for d in left if d[0] == doc and len(encode.encode(d[1] or "").ids) + 1 == tokens)
        left.remove(found)
        texts[row] = found[1]
    assert check_pieces(texts, rows, 128) == 0
    # the hot source holds its share of every window but the last ones
    total = sum(r.length for r in out)
    hot = {row for row, p in keyed.items() if p[0].doc_id is not None and (p[0].doc_id % 3 == 0 and p[0].doc_id != 7)}
    share = sum(r.length for r in out if r.row in hot) / total
    by_window = defaultdict(int)
    for r in out:
        if r.row in hot:
            by_window[r.sequence_id] += r.length
    full = total // 128
    assert all(abs(by_window[w] - 128 * share) <= 32 for w in range(full - 2))


def test_weights_and_shared_queue(spark):
    docs = [(i, "one two three four five " * 40, f"s{i % 5}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixture.pack_mixture(df, {"s0": 6.0}, capacity=512, min_piece=16).collect()
    first = [r for r in out if r.sequence_id < 20]
    assert abs(sum(r.length for r in first if r.doc_id % 5 == 0) / sum(r.length for r in first) - 0.6) < 0.01
    assert check_pieces({i: t for i, t, _ in docs}, [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in out], 512) == 0
    few = mixture.pack_mixture(df, capacity=512, max_queues=3).collect()
    assert check_pieces({i: t for i, t, _ in docs}, [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in few], 512) == 0
    with pytest.raises(ValueError):
        mixture.pack_mixture(df, {"s0": 0.0})


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    assert mixture.pack_mixture(df.limit(0)).count() == 0
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = mixture.pack_mixture(spark.createDataFrame([(1, long, "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert check_pieces({1: long, 2: None}, [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows]) == 0
