"""BPE encoding and decoding with a pair occurrence index (operator 3).

All distinct words of a block of a partition lie in one symbol array. An index maps the rank
of each mergeable adjacent pair to all positions where it stands. The active ranks are taken
in ascending order: every position in the list of a rank is merged at once, and the lists of
the pairs that arise left and right of the merged positions are extended. A word is therefore
encoded once per block, however often it stands in the texts.

Texts are cut at white space first; the words found are encoded apart, which is exact for
this tokenizer: its pattern never matches over white space and the normalizer acts on each
character alone or with following marks. White space is only used to cut when it is ASCII,
other cases (marks, digits and letters outside Latin-1, control characters) take the tokenizers
library's own normalizer and splitter, word by word.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import blocks, id_and_text

VOCABULARY = "word_bpe_49k.json"
#: Words kept in a Python worker between blocks.
CACHED_WORDS = 1_200_000
#: Longer words aren't kept.
CACHED_BYTES = 64

_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_NO_RANK = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairIndexEncoder:
    """Ids of words and texts as the tokenizers library gives them for the file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.special_start = min((t[0] for t in self.special), default="\0")
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.width = len(self.tokens)
        keys = self.left * self.width + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.library = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        # an earlier rank may arise only from a token that a later rank makes; those need word order
        first_use = np.full(self.width, _NO_RANK)
        ranks = np.arange(len(merges))
        np.minimum.at(first_use, self.left, ranks)
        np.minimum.at(first_use, self.right, ranks)
        self.ascending = bool((first_use[self.made] > ranks).all())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], _NO_RANK)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (each of one byte or more), and where each word's ids start (one more at the end)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths)
        starts = stops - lengths
        sym = np.append(self.inner[data], -1)  # one more: what stands beyond a word's ends
        sym[stops - 1] = self.final[data[stops - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[stops - 1], before[starts] = n, n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(at: np.ndarray) -> None:
            """Put positions in the lists of the pairs that start there."""
            rank = self.ranks(sym[at], sym[after[at]])
            known = rank < _NO_RANK
            at, rank = at[known], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], edges))].tolist(), np.split(at, edges), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        file(np.flatnonzero(after[:n] < n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b, t = self.left[r], self.right[r], self.made[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]  # older entries may be out of date
            if a == b and len(at) > 1:  # in a run of one symbol pairs are taken from the left
                at = np.sort(at)
                taken, last = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != last:
                        taken.append(p)
                        last = q
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone] = t, -2
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            file(np.concatenate((ahead[ahead < n], at[beyond < n])))
        live = sym[:n] >= 0
        counts = np.add.reduceat(live, starts, dtype=np.int64) if n else np.zeros(0, np.int64)
        return sym[:n][live].astype("<u4"), np.concatenate(([0], np.cumsum(counts)))

    def pieces(self, word: str) -> list[bytes | int]:
        """A word without ASCII white space as byte strings to be merged and ids of special tokens."""
        if _PLAIN.fullmatch(word) and self.special_start not in word:
            return [p.encode() for p in _PIECES.findall(word.lower())]
        found: list[bytes | int] = []
        for part in self.cut_special.split(word):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                found += [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian ids of words without ASCII white space."""
        number: dict[bytes, int] = {}
        single, several = [], []
        for w in new:
            if w.isalpha():  # ASCII letters alone
                single.append((w, number.setdefault(w.lower(), len(number))))
            else:
                parts = self.pieces(w.decode())
                several.append((w, [number.setdefault(p, len(number)) if isinstance(p, bytes) else p.to_bytes(4, "little") for p in parts]))
        ids, starts = self.encode_words(list(number)) if number else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        raw, starts = ids.tobytes(), (starts * 4).tolist()
        encoded = [raw[i:j] for i, j in zip(starts, starts[1:], strict=False)]
        found = {w: encoded[k] for w, k in single}
        found.update((w, b"".join([encoded[k] if isinstance(k, int) else k for k in parts])) for w, parts in several)
        return found

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text (None: empty)."""
        # bytes.split() cuts at ASCII white space alone
        split = [t.encode().split() if t else [] for t in texts]
        if len(self.cache) > CACHED_WORDS:
            # words met first are mostly the frequent ones
            self.cache = dict(itertools.islice(self.cache.items(), CACHED_WORDS // 2))
        cache = self.cache
        new = set().union(*split).difference(cache)
        cache.update(self.learn(list(new)))
        out = [b"".join(map(cache.__getitem__, ws)) for ws in split]
        for w in new:
            if len(w) > CACHED_BYTES:
                del cache[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder: the tokens, special ones too, joined by spaces (unknown ids give nothing)."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i is not None and 0 <= i < len(tokens) and tokens[i]])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    """One encoder for each Python worker."""
    return PairIndexEncoder(path)


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, decoded string]) for every row of ``df``.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and null ids give
    a row each; other columns of ``df`` are not read. An empty table gives none.
    """
    path = path or default_vocabulary()
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 8 << 20):
            coder = encoder(path)
            raw = coder.encode_texts(block.column("text").to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
            ids = np.frombuffer(b"".join(raw), "<i4")
            columns = [block.column("doc_id").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            if decoded:
                tokens = np.array(coder.tokens, object)
                columns.append(pa.array([" ".join(tokens[ids[i:j]]) for i, j in zip(ends, ends[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return id_and_text(df, id_col, text_col).mapInArrow(run, T.StructType(fields))


def decode(col: Column | str, path: str | None = None) -> Column:
    """The text of a column of ids (null or empty: the empty text)."""
    path = path or default_vocabulary()

    @F.pandas_udf(T.StringType())
    def run(ids: pd.Series) -> pd.Series:
        coder = encoder(path)
        return ids.map(lambda x: "" if x is None else coder.decode(x)).astype(object)

    return run(col)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Digest of every document's ids and decoded text."""
    from tallyspark.llm.common import table

    out = encode(table(spark, sf_dir), decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
