"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 4).

A word is the average of the embeddings of its character n-grams (hashed to ``BUCKETS``), a window
of ``WINDOW`` words the average of its words (a shorter text is filled up with zeros, and a word that
stood in the ``WINDOW`` words before counts as zero, so that one word said over and over is no more
than one word), and a linear softmax over that average gives the probability of the label. Embeddings and softmax are trained jointly in numpy, so an unseen
misspelling shares the vectors of the n-grams it kept. A text scores as its worst window, so a long
text doesn't dilute what it holds; windows overlap by half.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, those of the smallest hashes of
their ids. Scores of all texts are computed in the executors from one number for each n-gram: the
embedding times the difference of the two softmax columns (``BUCKETS`` floats, 1 MB, of fixed size).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import crc32_of_id, give_back, table

TRAIN_ROWS = 6_000
BUCKETS = 1 << 18
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 96
#: Training steps, each on ``BATCH`` texts, whatever the number of texts.
STEPS, BATCH = 150, 256
#: Share of a text's words left out in each training step, and decay of the weights, against learning texts by heart.
DROP = 0.3
DECAY = 0.01
FOLDS, HELD_OUT = 5, 0
WORDS_KEPT = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of ``<word>``, and the number of the word that each is of, in
    order of the words. Every word has one at least."""
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    stops = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    room = stops[word] - np.arange(len(data))  # bytes left in the word
    buckets, owners = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            at = np.flatnonzero(room[: len(h)] >= n)
            x = (h[at] + np.uint64(n)) * _MIX
            x = (x ^ (x >> np.uint64(32))) * _MIX
            buckets.append((x >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(word[at])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], owners[order]


def word_logits(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    if not words:
        return np.zeros(0)
    buckets, owners = grams(words)
    return np.bincount(owners, weights[buckets], len(words)) / np.bincount(owners, minlength=len(words))


def fresh(ids: np.ndarray) -> np.ndarray:
    """Which words didn't stand in the ``WINDOW`` words before."""
    order = np.argsort(ids, kind="stable")
    again = np.zeros(len(ids), bool)
    again[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (order[1:] - order[:-1] <= WINDOW)
    return ~again


def worst(values: np.ndarray) -> tuple[int, int, float]:
    """The window of the largest sum of ``values``: its ends and its mean."""
    n = len(values)
    if n <= WINDOW:
        return 0, n, float(values.sum()) / WINDOW
    sums = np.concatenate(([0.0], np.cumsum(values)))
    starts = np.append(np.arange(0, n - WINDOW, WINDOW // 2), n - WINDOW)
    within = sums[starts + WINDOW] - sums[starts]
    k = int(within.argmax())
    return int(starts[k]), int(starts[k]) + WINDOW, float(within[k]) / WINDOW


class Model:
    """``weights``: for each bucket; ``bias``: of the softmax. Log odds of a window: the mean of its
    words' weights and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scorer(self):
        number: dict[bytes, int] = {}
        logits = np.zeros(0)

        def score(texts: Iterable[str | None]) -> np.ndarray:
            nonlocal logits
            split = [tokens(t) for t in texts]
            if len(number) > WORDS_KEPT:
                number.clear()
                logits = np.zeros(0)
            new = list(set().union(*split).difference(number)) if split else []
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            logits = np.concatenate([logits, *(word_logits(new[at : at + 50_000], self.weights) for at in range(0, len(new), 50_000))])
            out = np.empty(len(split))
            for k, words in enumerate(split):
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                out[k] = worst(logits[ids] * fresh(ids))[2] + self.bias if len(words) else self.bias
            return 1 / (1 + np.exp(-np.clip(out, -500, 500)))

        return score


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS, seed: int = 7, rate: float = 0.05) -> Model:
    """Joint training by Adam. In each batch a text stands for its worst window under the model as it
    is, so windows need no labels of their own."""
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    soft = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    y = np.asarray(labels, np.int64)
    share = np.bincount(y, minlength=2) / max(len(y), 1)
    if not share.all():  # nothing to tell apart
        return Model(np.zeros(BUCKETS), -20.0 if share[0] else 20.0 if share[1] else 0.0)
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in tokens(t)], np.int32) for t in texts]
    keep = [k for k, w in enumerate(ids) if len(w)]
    first = [fresh(w) for w in ids]
    words, buckets, counts = list(number), [], []
    del number
    for at in range(0, len(words), 20_000):
        bucket, owner = grams(words[at : at + 20_000])
        buckets.append(bucket.astype(np.int32))
        counts.append(np.bincount(owner))
    del words
    if not keep:
        return Model(np.zeros(BUCKETS), 0.0)
    buckets, counts = np.concatenate(buckets), np.concatenate(counts)
    firsts = np.concatenate(([0], np.cumsum(counts)))

    def all_logits() -> np.ndarray:
        flat = (table_ @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        return np.concatenate([np.add.reduceat(flat[buckets[firsts[at] : firsts[min(at + 20_000, len(counts))]]], firsts[at : at + 20_000][: len(counts) - at] - firsts[at]) for at in range(0, len(counts), 20_000)]) / counts

    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table_, soft, bias)]
    step = 0
    for epoch in range(-(-steps // -(-len(keep) // BATCH))):
        order = rng.permutation(keep)
        logit = all_logits() if epoch else None  # under the model as it is, for choosing windows
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            rows, cols, sizes = [], [], []
            for r, k in enumerate(chosen):
                w, once = ids[k], first[k]
                if len(w) > WINDOW and epoch:
                    i, j, _ = worst(logit[w] * once)
                    w, once = w[i:j], once[i:j]
                sizes.append(max(len(w), WINDOW))
                w = w[once]
                stay = w[rng.random(len(w)) >= DROP]
                w = stay if len(stay) else w
                rows.append(np.full(len(w), r))
                cols.append(w)
            rows, cols = np.concatenate(rows), np.concatenate(cols)
            used, cols = np.unique(cols, return_inverse=True)
            length = counts[used]
            starts = np.concatenate(([0], np.cumsum(length)))[:-1]
            gram = buckets[np.repeat(firsts[used] - starts, length) + np.arange(length.sum())]
            word_vec = np.add.reduceat(table_[gram], starts, axis=0) / length[:, None]
            n = np.array(sizes)[:, None] * (1 - DROP)
            doc_vec = np.stack([np.bincount(rows, word_vec[cols, d], len(chosen)) for d in range(DIMENSIONS)], 1) / n
            z = doc_vec @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p.copy()
            g[np.arange(len(chosen)), y[chosen]] -= 1
            g /= len(chosen)
            d_doc = g @ soft.T / n
            d_word = np.stack([np.bincount(cols, d_doc[rows, d], len(used)) for d in range(DIMENSIONS)], 1) / length[:, None]
            spread = np.repeat(d_word, length, axis=0)
            d_table = np.stack([np.bincount(gram, spread[:, d], BUCKETS) for d in range(DIMENSIONS)], 1)
            step += 1
            table_ *= 1 - rate * DECAY
            for param, grad, (m, v) in zip((table_, soft, bias), (d_table, doc_vec.T @ g, g.sum(axis=0)), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(table_ @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, exclude: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _label) of at most ``rows`` labelled documents, half of them of either label if there
    are so many, by the smallest hashes of their ids; of rows of one id the text of the smallest
    hash. Rows with a null id or label are not used."""
    known = labels.select(labels[id_col].cast("long").alias("_id"), labels[label].cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    if exclude is not None:
        known = known.where(~exclude)
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    half = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows // 2) for k in (0, 1)]
    chosen = F.broadcast(half[0].union(half[1]))  # bounded by ``rows``
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    # one row an id, so that the bound holds for rows too
    first = F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text")))
    return texts.join(chosen, "_id").groupBy("_id", "_label").agg(first.alias("_text")).select("_id", "_text", "_label")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fitted on rows outside the held-out fold alone, in one task: the driver gets the weights of the buckets, no texts."""
    held = crc32_of_id("_id") % FOLDS == HELD_OUT

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat([pd.DataFrame({"_id": [], "_text": [], "_label": []}), *parts], ignore_index=True).sort_values(["_id", "_text"], ignore_index=True)
        model = fit(found["_text"].tolist(), found["_label"].tolist())
        del found
        give_back()
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    found = training_rows(docs, labels, rows=rows, exclude=held).repartition(1).mapInPandas(run, "weights binary, bias double").first()
    if found is None:
        return fit([], [])
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"])


def score_column(model: Model, text: Column) -> Column:
    """The probability of the label for each text; null and empty texts score as the bias alone."""
    shared = {"model": model}

    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared["model"].scorer()
        for part in parts:
            found = [score([None if t is None else t for t in part.iloc[at : at + 2000]]) for at in range(0, len(part), 2000)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))
        give_back()

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts have the score of the bias. Repeated rows and null ids give a row each;
    other columns are not read. Without labels of both kinds the model knows only the one kind it
    saw (none: score 0.5). An empty table gives no rows.
    """
    model = train(docs, labels)
    out = docs.select(docs[id_col].cast("long").alias("doc_id"), score_column(model, docs[text_col].cast("string")).alias("score"))
    return out.select("doc_id", (crc32_of_id("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, docs: DataFrame, labels: DataFrame, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that score below ``limit`` under a model of the labelled ``docs``.
    Null and empty texts have the score of the bias; repeated rows stay or go together."""
    return df.where(score_column(train(docs, labels), df[text_col].cast("string")) < limit)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir), table(spark, sf_dir, "labels"))
