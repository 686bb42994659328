"""Importance resampling and the CRCs of word runs against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import resampling

TEXTS = [
    (1, "The quick-brown fox, the QUICK brown fox! " * 6), (2, None), (3, ""), (4, "..."), (5, "Ünïcode éé ½ naïve日本 x\x00y " * 7), (6, " ".join(f"w{i % 977}" for i in range(60_000))),
    (7, "same words again " * 10), (8, "same words again " * 10), (8, "same words again " * 10), (None, "a row without an id " * 9), (9, "short"), (10, "É" * 5_000), (11, "target words stand here " * 8),
]


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, longest, buckets):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, percent, longest, buckets, least):
    s = Counter(f for _, t in docs for f in features_of(t, longest, buckets))
    t = Counter(f for x in target for f in features_of(x, longest, buckets))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (ns + buckets)) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)}
    out = []
    for d, text in docs:
        f = features_of(text, longest, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ranked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = ranked[: percent * len(ranked) // 100]
    return sorted(map(str, out)), [(r[0], r[4]) for r in drawn]


def test_against_plain_python(spark):
    target = ["target words stand here", None, "the quick", ""]
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("score", F.lit(1)).withColumn("rank", F.lit(2)).repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, longest, buckets, least in ((50, 1, 10_000, 20), (100, 3, 97, 1), (0, 2, 1000, 20)):
        rows = resampling.resample(df, goal, percent=percent, longest=longest, buckets=buckets, least_words=least).collect()
        everyone, drawn = expected(TEXTS, target, percent, longest, buckets, least)
        assert sorted(str((r.doc_id, r.n_words, r.n_features, r.weight, r.score)) for r in rows) == everyone
        assert [(r.doc_id, r.score) for r in sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
        assert sorted(r["rank"] for r in rows if r["rank"] is not None) == list(range(1, len(drawn) + 1))
    assert resampling.resample(df.limit(0), goal).count() == 0
    assert resampling.resample(df, goal.limit(0)).count() == len(TEXTS)


def test_crcs_of_joined_words():
    rng = random.Random(5)
    a = [rng.randbytes(rng.randrange(40)) for _ in range(300)]
    b = [rng.randbytes(rng.randrange(3000)) for _ in range(300)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (resampling.joined_crc(crc(a), crc(b), np.array(list(map(len, b)))) == crc([x + y for x, y in zip(a, b, strict=True)])).all()


def test_dictionary_finds_only_whole_words():
    text = "a ab b abc bc c a"
    crc, length = resampling.Dictionary(set(text.split())).payloads(f" {text} ", 7)
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in text.split()] and length.tolist() == [1, 2, 1, 3, 2, 1, 1]
