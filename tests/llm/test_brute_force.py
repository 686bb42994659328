"""Operators against brute force, round trips, invariants and held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, context_tree, embeddings, hilbert, licenses, line_dedup, minhash, packing, toxicity
from tallyspark.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def groups(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# ------------------------------------------------------------ 1 licenses
def test_regions():
    a = licenses.Automaton.compiled("x", "one [[two three]] four <1-2> five")
    for text, hit in [("one four q five", True), ("one two three four q r five", True), ("one two four q five", False), ("one four five", False), ("one four q r s five", False), ("zero one four q five six", True)]:
        assert bool(a.places(text.encode().split())) == hit, text


# ----------------------------------------------------------------- 3 bpe
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(bpe.default_vocabulary()), bpe.encoder(bpe.default_vocabulary())
    rnd = random.Random(3)
    letters = "aaabbeéèßÀİıǅσςΣ̧́  \x1c\x85'sTRElldmv019²½٣中文🎉\n\t<|>\x00\x7f﻿​"
    sample = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    sample += ["a<|startoftext|>b <|endoftext|>X<|ENDOFTEXT|>", "aaaaaaaaaaa", "abab" * 500]
    for text, raw in zip(sample, coder.encode_texts(sample), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == expected and coder.decode(ids) == library.decode(expected, skip_special_tokens=False), text


def test_decode_column(spark):
    df = spark.createDataFrame([([320, 1125],), ([],), (None,)], "ids array<int>")
    coder = bpe.encoder(bpe.default_vocabulary())
    assert [r[0] for r in df.select(bpe.decode("ids")).collect()] == [coder.decode([320, 1125]), "", ""]


# ------------------------------------------------------------ 4 toxicity
def test_misspellings_share_vectors():
    rnd = random.Random(5)
    clean = ["gentle", "river", "window", "garden", "letter", "music", "paper", "morning", "forest", "bread"]
    bad = ["wretchface", "grumblesnout", "mudbrained"]
    rows = [([*rnd.choices(clean, k=30)], 0) for _ in range(150)] + [([*rnd.choices(clean, k=29), rnd.choice(bad)], 1) for _ in range(150)]
    model = toxicity.fit([" ".join(w) for w, _ in rows], [y for _, y in rows])
    score = model.scorer()
    assert score([" ".join([*rnd.choices(clean, k=29), w]) for w in ("wretchfaces", "grumblesnouty", "mudbraind")]).min() > 0.5
    assert score([" ".join(rnd.choices(clean, k=40)) for _ in range(20)]).max() < 0.5
    assert score([" ".join(rnd.choices(clean, k=4000)) + " mudbrained mudbraind"])[0] > 0.5


def test_held_out_accuracy(spark):
    rows = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    better = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert better > 0.8 and ((s >= 0.5) == (y == 1)).mean() > 0.9  # few labels here; README has figures of larger tables


# -------------------------------------------------- 5 packing, 6 sharding
def test_packing(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    rows = packing.op5_best_fit_packing(spark, SF).collect()
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [(k, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048)) for p in [ids[at : at + 2048]]]
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= math.ceil(sum(r.length for r in rows) / 2048) * 1.03 + 1


def test_bounded_bins():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (1, 7)]  # opening bin 2 closes bin 2, the fullest


def test_hilbert_curve_is_a_walk():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    walk = cells[np.argsort(hilbert.hilbert_index(cells, 3))]
    assert sorted(hilbert.hilbert_index(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, texts):
    rows = hilbert.op6_hilbert_shards(spark, SF).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_shards_in_the_order_of_the_curve(spark, texts):
    """Rows sorted by the curve's index of their group's cells, cut by count: the whole assignment."""
    rows = hilbert.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    names = {c: sorted({r[c] for r in rows}) for c in ("lang", "source")}
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(texts[r.doc_id], r)

    def cell(r):
        g = first[texts[r.doc_id]]
        rank = [sum(names[c].index(x) * 32 // len(names[c]) <= names[c].index(g[c]) * 32 // len(names[c]) for x in names[c]) - 1 for c in ("lang", "source")]
        starts = [[i * 32 // len(names[c]) for i in range(len(names[c]))][k] for c, k in zip(("lang", "source"), rank, strict=True)]
        return [min(31, int(math.log2(r["size"]) * 1.5)), *starts]

    index = hilbert.hilbert_index(np.array([cell(r) for r in rows]), 5).tolist()
    assert [r.hilbert for r in rows] == index
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    place = [(r.hilbert, r["size"], r.text_crc32) for r in ordered]
    assert place == sorted(place)
    # equal texts are neighbours, so a shard's end cuts one group at most
    held = {}
    for r in rows:
        held.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) - 1 for s in held.values()) <= 7


def test_shards_prune(spark, tmp_path):
    """Minima and maxima of the shards rule out shards for equality filters on languages and sources."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["text"])
    hilbert.write_shards(hilbert.shard_documents(docs), str(tmp_path / "out"))
    ranges = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        for c in ("lang", "source"):
            ranges.setdefault((c, r.shard), set()).add(r[c])
    for c, most in (("lang", 0.7), ("source", 0.8)):
        names = set().union(*(v for (k, _), v in ranges.items() if k == c))
        read = [sum(min(v) <= n <= max(v) for (k, _), v in ranges.items() if k == c) / 8 for n in names]
        assert sum(read) / len(read) <= most, (c, read)


def test_rules_by_rejection_per_cost():
    """The cheap rule first; then what it leaves decides, and statistics computed before cost nothing."""
    from tallyspark.llm.quality import cheapest_first

    found = [((True, True, False), 60), ((False, True, False), 5), ((False, False, True), 20), ((False, False, False), 15)]
    assert cheapest_first(found, [("a",), ("b",), ("c",)], {"a": 1.0, "b": 1.0, "c": 1.0}) == [1, 2, 0]
    assert cheapest_first(found, [("a",), ("b",), ("c",)], {"a": 0.1, "b": 1.0, "c": 1.0}) == [0, 2, 1]
    assert cheapest_first(found, [("a",), ("a", "b"), ("b",)], {"a": 0.0, "b": 1.0}) == [0, 2, 1]
    assert cheapest_first([], [("b",), ("a",)], {"a": 1.0, "b": 2.0}) == [0, 1]


def test_statistics_behind_a_rejecting_rule(spark):
    """A statistic is null in rows that a rule before its own rejected, and there in the others."""
    from tallyspark.llm import quality

    rules = {r.name: r for r in quality.default_rules()}
    order = [rules[n] for n in ("short", "symbols", "shouting", "stutter")]
    rows = [(1, "too short"), (2, "# " * 12), (3, "LOUD " * 12), (4, "plain words of a text that no rule at all rejects here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.verdict(quality.prepared(df), order).collect()}
    assert [(got[d].n_symbols, got[d].n_upper, got[d].n_stutter, got[d]._kept) for d in (1, 2, 3, 4)] == [(None, None, None, False), (12, None, None, False), (0, 48, None, False), (0, 0, 0, True)]


# ---------------------------------------------------------- 7 line dedup
def test_patience_and_blocks():
    assert line_dedup.patience([1, 2, 3, 9, 4], [7, 1, 2, 8, 4]) == [(0, 1), (1, 2), (4, 4)]
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(0, 12))] for _ in "ab")
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_planted_passages(spark):
    rnd = random.Random(2)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    p, q, short = [line(20), line(20), line(20)], [line(60)], line(12)
    own = {k: [line(15) for _ in range(4)] for k in range(1, 8)}
    docs = {
        1: own[1][:2] + p + own[1][2:] + [short], 2: own[2] + q + [short], 3: own[3][:1] + q + own[3][1:2] + p + own[3][2:], 4: own[4] + [p[0]],
        5: own[5][:2] + p[:2] + [line(3)] + p[2:], 6: [*p, "", *own[6]], 7: own[1][:2] + p + own[1][2:] + [short],
    }
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.line_dedup(df).collect()}
    assert got[1] == docs[1] and got[2] == docs[2] and got[4] == docs[4] and got[5] == docs[5]
    assert got[3] == own[3]  # both passages, though in another order
    assert got[6] == ["", *own[6]]
    assert got[7] == [""]


def test_line_dedup_on_documents(spark, texts):
    """Every line of 50 words and more that an earlier document has goes; nothing goes that no earlier document has."""
    first, changed = {}, 0
    left = {r.doc_id: r for r in line_dedup.op7_line_dedup(spark, SF).collect()}
    for doc in sorted(texts):
        lines = texts[doc].split("\n")
        gone = {int(x) for x in left[doc].deleted.split(",") if x}
        for k, x in enumerate(lines):
            if k in gone:
                assert first[x] < doc
            elif len(x.split()) >= 50:
                assert first.get(x, doc) == doc
        changed += bool(gone)
        for x in lines:
            first.setdefault(x, doc)
        assert left[doc].left_crc32 == zlib.crc32("\n".join(x for k, x in enumerate(lines) if k not in gone).encode())
    assert changed


def blocks_of(doc, min_words):
    """Every block of consecutive lines of ``min_words`` words and more; a document is a list of (line, words)."""
    return [(a, b) for a in range(len(doc)) for b in range(a + 1, len(doc) + 1) if sum(w for _, w in doc[a:b]) >= min_words]


def test_lines_of_a_pair_against_all_blocks():
    pair = lambda first, later: line_dedup.repeated_lines(*([(k, k, x, w) for k, (x, w) in enumerate(d)] for d in (first, later)), 50)
    assert sorted(pair([(x, 12) for x in (1, 2, 3, 99, 1, 2, 3, 4, 5)], [(x, 12) for x in (1, 2, 3, 4, 5)])) == [0, 1, 2, 3, 4]
    rnd = random.Random(10)
    for _ in range(1000):
        words = [rnd.choice([3, 12, 20, 30, 55]) for _ in range(5)]
        first, later = ([(x, words[x]) for x in rnd.choices(range(5), k=rnd.randint(0, 14))] for _ in "ab")
        held = {tuple(first[a:b]) for a, b in blocks_of(first, 50)}
        assert sorted(pair(first, later)) == sorted({k for a, b in blocks_of(later, 50) if tuple(later[a:b]) in held for k in range(a, b)})


def test_blocks_against_all_holders(spark):
    """Passages whose lines first stand elsewhere, and random documents of few lines: whatever block any earlier document has goes."""
    rnd = random.Random(11)
    text = lambda x, w: " ".join(f"{x}w{k}" for k in range(w))
    split = [(f"p{k}", 10) for k in range(8)]
    docs = [split[:4] + [("new", 10)] + split[4:], split, split, split[2:]]
    docs += [[(f"q{k}", 10) for k in range(4)], [(f"q{k}", 10) for k in range(4, 8)], *[[(f"q{k}", 10) for k in range(8)]] * 3]
    for _ in range(150):
        docs.append([(f"r{x}", [4, 12, 20, 30, 40, 55][x % 6]) for x in rnd.choices(range(14), k=rnd.randint(0, 10))])
    left = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame([(k, "\n".join(text(*x) for x in d)) for k, d in enumerate(docs)], "doc_id long, text string")).collect()}
    held: set = set()
    for k, d in enumerate(docs):
        own = blocks_of(d, 50)
        gone = {x for a, b in own if tuple(d[a:b]) in held for x in range(a, b)}
        assert left[k] == "\n".join(text(*x) for n, x in enumerate(d) if n not in gone), k
        held |= {tuple(d[a:b]) for a, b in own}


# -------------------------------------------------------- 8 context tree
def tree_probability(history, context, byte, depth):
    """Probability of a byte after a context, by the recursive definition over all training steps (context, byte)."""
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def counts(node, ending):
        found = [(b >> (7 - len(node))) & 1 for c, b in history if c[len(c) - len(ending) :] == ending and [(b >> (7 - k)) & 1 for k in range(len(node))] == node]
        return found.count(0), found.count(1)

    def weighted(node, ending):
        z, o = counts(node, ending)
        if not z + o:
            return 0.0
        if len(ending) == depth:
            return kt(z, o)
        below = sum(weighted(node, (x, *ending)) for x in {c[len(c) - len(ending) - 1] for c, _ in history})
        return math.log(0.5) + np.logaddexp(kt(z, o), below)

    total, node = 0.0, []
    for k in range(8):
        p, left, one = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            ending = context[depth - d :]
            z, o = counts(node, ending)
            if not z + o:
                break
            est = (o + 0.5) / (z + o + 1)
            one = p + left * est
            stop = 1.0 if d == depth else math.exp(math.log(0.5) + kt(z, o) - weighted(node, ending))
            p, left = p + left * stop * est, left * (1 - stop)
        bit = (byte >> (7 - k)) & 1
        total += math.log(one if bit else 1 - one)
        node.append(bit)
    return total


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_tree_against_its_definition(spark, depth):
    rnd = random.Random(4)
    history = [(tuple(rnd.choice(b"ab ") for _ in range(depth)), rnd.choice(b"abc")) for _ in range(60)]
    counted = Counter(history)
    pack = lambda c: sum(x << (8 * k) for k, x in enumerate(reversed(c)))
    unseen = [((*b"ba"[: depth - 1], c)[-depth:] if depth < 3 else (*b"zba", c), b) for c in b"abz" for b in b"abq"]
    rows = [(pack(c), b, n) for (c, b), n in counted.items()] + [(pack(c), b, 0) for c, b in unseen if (c, b) not in counted]
    got = {(r.context, r.byte): r.lp for r in context_tree.byte_scores(spark.createDataFrame(rows, "context long, byte int, n long"), depth).collect()}
    for c, b in [*counted, *unseen]:
        assert got[pack(c), b] == pytest.approx(tree_probability(history, c, b, depth), abs=1e-9)


def test_bytes_sum_to_one(spark):
    rows = [(c, b, n) for c in (0x6162, 0x6163) for b, n in {**dict.fromkeys(range(256), 0), 97: 9, 98: 4, 32: 1 if c == 0x6162 else 0}.items()]
    got = context_tree.byte_scores(spark.createDataFrame(rows, "context long, byte int, n long"), 2).groupBy("context").agg(F.sum(F.exp("lp")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([1.0, 1.0], abs=1e-9)


def test_base_scores(spark, texts):
    rows = {r.doc_id: r for r in context_tree.op8_context_tree(spark, SF).collect()}
    words = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    known = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    total = sum(known.values())
    for d, ws in words.items():
        assert (rows[d].held_out, rows[d].n_tokens, rows[d].n_known, rows[d].train_tokens) == (held[d], len(ws), sum(known[w] > 0 for w in ws), total)
        assert rows[d].base_score == pytest.approx(sum(math.log10((known[w] + 0.5) / (total + 0.5 * (len(known) + 1))) for w in ws))
    assert 1 < np.mean([r.bits_per_byte for r in rows.values() if r.held_out]) < 3.2


def test_contexts_cross_words(spark):
    """Scores of whole texts by the definition; the order of words counts."""
    texts = ["ab ba ab ba", "ab ba ab ba", "ba ba ab ab", "ab ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in context_tree.context_tree_scores(df, F.col("doc_id") >= 2, depth=3).collect()}
    steps = {}
    for d, t in enumerate(texts):
        kind = context_tree.class_of(Counter(context_tree.words_of(t)))
        data = bytes([kind]) * 3 + t.encode() + b"  "
        steps[d] = kind, [(tuple(data[k - 3 : k]), data[k]) for k in range(3, len(data))]
    history = steps[0][1] + steps[1][1]
    classes = Counter(steps[d][0] for d in (0, 1))
    for d, (kind, own) in steps.items():
        cost = math.log((classes[kind] + 0.5) / (2 + 0.5 * (context_tree.CLASSES + 1)))
        assert got[d] == pytest.approx((cost + sum(tree_probability(history, c, b, 3) for c, b in own)) / math.log(10), abs=1e-8)
    assert got[0] > got[2] + 0.1


# -------------------------------------------------------- 9, 10 near-dup
def test_components(spark):
    rnd = random.Random(6)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2300)] + [(5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == groups({x for p in real for x in p}, real)


def test_vectors_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, ids = x @ x.T >= 0.9, [r.vec_id for r in rows]
    got = {r.vec_id: r for r in embeddings.op9_embedding_dedup(spark, SF).collect()}
    true = {d: int(n) - 1 for d, n in zip(ids, near.sum(axis=1), strict=True)}
    assert all(got[d].n_links <= true[d] for d in ids)
    assert sum(got[d].n_links for d in ids) >= 0.95 * sum(true.values())


def test_planted_vectors_against_all_pairs(spark):
    """Pairs at 0.90 to 0.95, a star whose leaves mostly link with the hub alone, and a dense group, each larger than any window."""
    rnd = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)

    def at_cosine(x, c):
        noise = rnd.normal(size=x.shape)
        noise = unit(noise - (noise * x).sum(axis=-1, keepdims=True) * x)
        return np.asarray(c)[..., None] * x + np.sqrt(1 - np.asarray(c)[..., None] ** 2) * noise

    hub, centre, singles = unit(rnd.normal(size=64)), unit(rnd.normal(size=64)), unit(rnd.normal(size=(1500, 64)))
    star = at_cosine(np.tile(hub, (1600, 1)), np.full(1600, 0.92))
    dense = at_cosine(np.tile(centre, (1300, 1)), np.full(1300, 0.97))
    x = np.concatenate([singles, at_cosine(singles[:500], rnd.uniform(0.901, 0.95, 500)), hub[None], star, dense]).astype(np.float32)
    ids = rnd.permutation(len(x)).tolist()
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "vec_id long, embedding array<float>")).collect()}
    x = unit(x.astype(np.float64))
    near = np.triu(x @ x.T >= 0.9, 1)
    true = dict(zip(ids, (near | near.T).sum(axis=1).tolist(), strict=True))
    expected = groups(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    assert max(true.values()) >= 1600 and sum(true.values()) > 1300 * 1299
    assert {d: r.n_links for d, r in got.items()} == true
    assert {d: (r.component_id, r.kept) for d, r in got.items()} == {d: (c, c == d) for d, c in expected.items()}


@pytest.mark.parametrize("classes", [500, 50_000, 500_000, 3_000_000])
def test_passes_hold_the_recall(classes):
    bits, passes = embeddings.bits_and_passes(classes, 0.9)
    assert classes / 2**bits <= embeddings.WINDOW / 2
    assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** passes >= embeddings.RECALL


def test_recall_of_the_windows_alone():
    """12,000 vectors, 1,000 pairs at cosine 0.9: the share that the sorted passes find, without the longer runs."""
    import pandas as pd

    rnd = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rnd.normal(size=(11_000, 32)))
    noise = rnd.normal(size=(1000, 32))
    noise = unit(noise - (noise * x[:1000]).sum(axis=1, keepdims=True) * x[:1000])
    x = np.concatenate([x, 0.9001 * x[:1000] + math.sqrt(1 - 0.9001**2) * noise])
    _, passes = embeddings.bits_and_passes(len(x), 0.9)
    found = set()
    for p, signature in enumerate(embeddings.signatures_of(x, passes, embeddings.SEED).T):
        order = np.argsort(signature)
        rows = pd.DataFrame({"pass": p, "dims": 32, "node": order, "v": [embeddings.packed(x[k]) for k in order]})
        found |= {(min(l), max(l)) for l in zip(*(e.tolist() for e in embeddings.window_links(rows, 0.9)), strict=True)}
    assert all(x[a] @ x[b] >= 0.9 for a, b in found)
    assert sum((k, 11_000 + k) in found for k in range(1000)) >= 999


def test_ranges_meet(spark, monkeypatch):
    """Many short ranges find what one range finds."""
    monkeypatch.setattr(embeddings, "RANGE_ROWS", 700)
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(600, 16))
    x = np.concatenate([x, x[:200] + rnd.normal(size=(200, 16)) * 0.1])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= 0.9, 1)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()}
    expected = groups(range(len(x)), np.argwhere(near).tolist())
    assert got == {d: (int(n), expected[d]) for d, n in enumerate((near | near.T).sum(axis=1).tolist())}


def test_near_documents_against_all_pairs(spark, texts):
    for shingle, df in ((4, minhash.op10_minhash(spark, SF)), (5, minhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")))):
        sets = {}
        for d, t in texts.items():
            w = t.encode().lower().split()
            sets[d] = {tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1 if w else 0))}
        links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
        expected = groups(sets, links)
        got = {r.doc_id: r for r in df.collect()}
        assert {d: r.component_id for d, r in got.items()} == expected
        assert all(r.n_shingles == len(sets[d]) and r.kept == (expected[d] == d) for d, r in got.items())


def test_one_group_of_many_near_copies(spark):
    """A chain and a star of near copies in the same buckets; every pair is tested or already joined."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    docs, now = [], base
    for k in range(60):
        now = list(now)
        now[rnd.randrange(200)] = f"c{k}"
        docs.append((k, " ".join(now)))
    for k in range(60, 120):
        copy = list(base)
        for at in rnd.sample(range(200), rnd.randint(0, 7)):
            copy[at] = f"s{k}_{at}"
        docs.append((k, " ".join(copy)))
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(197)} for d, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == groups(sets, links)


def test_crowded_buckets_in_chunks(spark, monkeypatch):
    """Families of texts about as alike as the threshold asks, in which many pairs are near it and no head
    links with all: chunks of 20 rows and 2,000 shingles give the links of all pairs."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 20)
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", 2_000)
    rng = np.random.default_rng(5)
    docs = []
    for _ in range(3):
        base = [f"w{x}" for x in rng.integers(0, 4000, 150)]
        for _ in range(60):
            w = list(base)
            for at in rng.choice(150, rng.integers(2, 5), replace=False):
                w[at] = f"v{rng.integers(0, 3)}"
            docs.append((len(docs), " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for d, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if (n := len(sets[a] & sets[b])) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    expected = groups(sets, links)
    assert 20 < len(set(expected.values())) < 160  # neither whole families nor single texts only
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == expected


def test_rejected_rows_have_all_statistics(spark, tmp_path):
    """op2_quality_cascade leaves no statistic out for a row that some rule rejects."""
    from tallyspark.llm.quality import op2_quality_cascade

    texts = [(1, "A a a"), (2, "ONE TWO\nONE TWO\n" + "WORD " * 30), (3, None), (4, " ".join(f"word{i}" for i in range(20)))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_quality_cascade(spark, str(tmp_path)).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert [(got[i].n_lines, got[i].n_upper, got[i].n_stutter) for i in (1, 2, 3, 4)] == [(1, 1, 1), (3, 132, 29), (0, 0, 0), (1, 0, 0)]


def test_tree_counts_by_definition_in_little_memory():
    import tracemalloc

    import numpy as np

    rnd = random.Random(5)
    texts = [(b"\x02" + bytes(rnd.choice(b"abcdefgh ") for _ in range(rnd.randrange(1, 300))), rnd.random() < 0.7) for _ in range(60)]
    expected = Counter()
    for text, learnt in texts:
        whole = text[:1] * 3 + text[1:] + b" "
        for i in range(3, len(whole)):
            expected[whole[i] | sum(whole[i - d] << (8 * d) for d in range(1, 4))] += learnt
    counts = context_tree.KeyCounts()
    for at in range(0, 60, 7):
        counts.add(texts[at : at + 7], 3)
    assert dict(zip(counts.key.tolist(), counts.n.tolist(), strict=True)) == dict(expected) and np.all(np.diff(counts.key) > 0)
    # what a task needs beside its block: 25 bytes a byte counted at a time, once 75
    many = [(bytes(row), True) for row in np.random.default_rng(1).choice(np.frombuffer(b"abcdefgh ", np.uint8), (1000, 2000))]
    tracemalloc.start()
    context_tree.KeyCounts().add(many, context_tree.DEPTH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000


def test_tree_logs_of_small_and_large_counts():
    import numpy as np

    zeros, ones = np.array([0.0, 3, 4095, 4096, 70_000]), np.array([0.0, 1, 4096, 0, 123_456])
    expected = [math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi) for z, o in zip(zeros, ones, strict=True)]
    assert context_tree.kt_logs(zeros, ones) == pytest.approx(expected, rel=1e-10, abs=1e-9)
