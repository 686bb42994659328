"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, context_tree, embeddings, hilbert, licenses, line_dedup, minhash, packing, quality, toxicity

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again, all rights reserved."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "short"),
    (7, "The quick brown fox jumps over the lazy dog again and again, all rights reserved."), (7, "The quick brown fox jumps over the lazy dog again and again, all rights reserved."),
    (None, "a row without an id but with more than ten words in its only line of text"), (None, None), (8, "é" * 50_000), (9, "x\x00y\x1cz \x85\xa0 naïve Ünïcode ﬁ ½ ²"),
]
CLASHES = ["ids", "score", "_text", "_words", "_rejected", "row", "rank", "rows", "k1", "k2", "gone", "class", "component", "number", "unit", "block", "shard", "n", "rep", "_id", "_in0", "kept"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d, t, None, None, 1) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3, 5, 6, 7)] + [(None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")


def digests(docs, labels):
    return {
        "licenses": licenses.scan(docs), "quality": quality.quality(docs), "bpe": bpe.encode(docs, decoded=True), "toxicity": toxicity.toxicity(docs, labels),
        "hilbert": hilbert.shard_documents(docs), "context_tree": context_tree.context_tree_scores(docs, F.lit(False)), "minhash": minhash.near_duplicates(docs), "line_dedup": line_dedup.line_dedup(docs),
    }


@pytest.mark.parametrize("name", ["licenses", "quality", "bpe", "toxicity", "hilbert", "context_tree", "minhash", "line_dedup"])
def test_a_row_for_each_row(docs, labels, name):
    rows = digests(docs, labels)[name].collect()
    assert len(rows) == len(TEXTS)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows) == sorted(-1 if d is None else d for d, _ in TEXTS)


@pytest.mark.parametrize("name", ["licenses", "quality", "bpe", "toxicity", "hilbert", "context_tree", "minhash", "line_dedup"])
def test_empty_table(docs, labels, name):
    assert digests(docs.limit(0), labels)[name].count() == 0


def test_defined_values(docs, labels):
    out = {k: {r["doc_id"]: r for r in v.collect() if r["doc_id"] is not None} for k, v in digests(docs, labels).items() if k in ("licenses", "quality", "bpe", "minhash", "hilbert", "context_tree")}
    assert out["licenses"][2].n_words == 0 and out["licenses"][2].labels == "" and out["licenses"][1].base_labels == "reserved"
    assert out["quality"][3].base_failed and not out["quality"][3].kept
    assert out["bpe"][2].ids == [] and out["bpe"][2].decoded == ""
    assert out["hilbert"][2]["size"] == 1 and out["hilbert"][2].text_crc32 == 0
    assert out["context_tree"][2].n_tokens == 1
    assert [out["minhash"][d].component_id for d in (1, 2, 3, 4, 7)] == [1, 2, 3, 4, 1] and not out["minhash"][7].kept


def test_packing_of_edges(docs):
    rows = packing.pack_documents(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1  # null: the end alone
    assert len([r for r in rows if r.doc_id == 7]) == 2  # a piece for each repeated row
    assert all(1 <= r.length <= 2048 for r in rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_filters_keep_columns(docs, labels):
    assert quality.keep_good(docs).columns == docs.columns
    assert toxicity.drop_toxic(docs, docs, labels).columns == docs.columns
    assert line_dedup.line_dedup(docs).columns == docs.columns
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 6, 8, 9, None}
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_vectors(spark):
    big = [1e200] * 4
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [None, 1.0], 0), (8, [float("inf"), 0.0], 0), (None, [1.0, 0.0], 0), (9, big, 0), (10, big, 0), (11, [0.95, 0.1], 0), (12, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("class", F.lit(1)).withColumn("node", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True), None: (0, None, True), 9: (1, 9, True), 10: (1, 9, False), 11: (2, 1, False), 12: (0, 12, True)}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_stages_on_edges(spark, docs, labels, tmpdir_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    labels.write.parquet(f"{tmpdir_path}/labels.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), tmpdir_path)
        assert empty.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert empty.columns == docs.columns, name
        assert stage(spark, docs, tmpdir_path).count() >= 0, name
    assert out.count() == len(TEXTS)
