"""Fill-in-middle against plain Python, and its exact round trip."""

import hashlib
import re
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import fill_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc, text, rate=50, spm=80):
    units = UNIT.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(q in text for q in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["one two three four", " lead and trail \n", "\x85 is \xa0 no \x1c space", "é 日本 😀 x", "has <M> inside", "", None, " \n\t ", "<P", "S> <", "a", " ".join(f"w{i}" for i in range(60_000)), "x" * 100_000]


def test_against_plain_python(spark):
    docs = [(i * 31 + j if i else None, t) for (i, t), j in product(enumerate(TEXTS), range(12))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("form", F.lit(1)).withColumn("output", F.lit(2))
    got = fim.fill_in_middle(df).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, t in docs:
        n, form, p, m, out = plain_version(d, t)
        want.append((d, n, form, p, m, out, sha(out), sha(t or "")))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    every = fim.fill_in_middle(df, rate=100, spm_rate=0, outputs=False)
    assert "output" not in every.columns and {r.form for r in every.where("n > 1").collect()} <= {"psm", "plain"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é<PSM>\n\t \x85日", max_size=40), st.integers(0, 10**12))
def test_round_trip(text, doc):
    raw = text.encode()
    n, form, places = fim.plan(doc, raw, rate=100)
    assert n == len(UNIT.findall(text))
    table = fim.PieceTable(raw).cut(places)
    if form != "plain":
        table = table.arranged(form)
    assert (n, form, table.read().decode()) == (lambda e: (e[0], e[1], e[4]))(plain_version(doc, text, rate=100))
    assert fim.restore(table.read(), form).read() == raw
    for k in range(n + 1):
        assert raw[: fim.unit_end(raw, k)].decode() == "".join(UNIT.findall(text)[:k])


def test_cutting_keeps_the_whole():
    table = fim.PieceTable(b"abcdef").cut([2, 2, 5])
    assert [bytes(x) for x in table.stretches()] == [b"ab", b"", b"cde", b"f"]
    again = table.cut([1, 6])
    assert again.read() == b"abcdef" and again.sha256() == hashlib.sha256(b"abcdef").hexdigest()
