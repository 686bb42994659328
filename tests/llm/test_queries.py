"""Registered queries against their DuckDB SQL, and the pipeline stage by stage against plain Python."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tallyspark.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = queries.QUERIES[name](spark, SF)
    expected = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, expected.fetchall()))


def kept_by_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n = len(words)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    twice = {w for w, k in Counter(windows).items() if k > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return not (
        n < 10 or 100 * len(covered) > 20 * n or chars < 2 * n or chars > 12 * n or 10 * sum(c in "#*$%&|<>" for c in text) > n
        or 100 * sum("A" <= c <= "Z" for c in text) > 40 * chars or 100 * (len(lines) - len(set(lines))) > 60 * len(lines) or 100 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > 30 * n
    )


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    table = {r.doc_id: r.text for r in docs.collect()}
    step = dict(corpus_pipeline.STAGES)

    good = step["quality_rules"](spark, docs, SF)
    table = {d: t for d, t in table.items() if kept_by_rules(t)}
    assert {r.doc_id: r.text for r in good.collect()} == table and good.columns == docs.columns

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    mild = step["toxicity"](spark, good, SF)
    ids = sorted(table)
    table = {d: table[d] for d, s in zip(ids, model.scorer()([table[d] for d in ids]), strict=True) if s < 0.5}
    assert {r.doc_id for r in mild.collect()} == set(table) and mild.columns == docs.columns

    cut = step["line_dedup"](spark, mild, SF)
    first, left = {}, {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and all(t.strip() for t in left.values())
    for d in sorted(table):
        lines, kept = table[d].split("\n"), left.get(d, "").split("\n")
        for x in set(lines):
            long_repeat = len(x.split()) >= 50 and first.get(x, d) != d
            assert not (long_repeat and x in kept)
            if first.get(x, d) == d and x.strip():
                assert x in kept
        for x in lines:
            first.setdefault(x, d)

    alone = step["minhash_near_dedup"](spark, cut, SF)
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for d, t in left.items() for w in [t.encode().lower().split()]}
    up = {}
    for d in sorted(sets):
        near = {up[e] for e in up if 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])}
        new = min([d, *near])
        up = {e: new if u in near else u for e, u in up.items()} | {d: new}
    assert {r.doc_id for r in alone.collect()} == {d for d, u in up.items() if u == d} and alone.columns == docs.columns

    packed = step["best_fit_packing"](spark, alone, SF).collect()
    assert {r.doc_id for r in packed} == {d for d, u in up.items() if u == d}
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))
