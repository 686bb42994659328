"""Fill-in-middle transformation with a piece table (operator 13).

A document is a list of descriptors, each a stretch of an immutable buffer: the text's bytes, or the
sentinels'. Cutting splits descriptors, an arrangement puts them in another order with sentinels
between, and the inverse arrangement restores the text; bytes are never moved until a result is read,
and hashes read the stretches one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import blocks, table

SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
_SPACES = b" \t\n\x0b\x0c\r"

#: (buffer, start, stop); buffer 0 is the text, 1 the sentinels.
Descriptor = tuple[int, int, int]
_MARKS: dict[bytes, Descriptor] = {m: (1, 3 * i, 3 * i + 3) for i, m in enumerate((PREFIX, SUFFIX, MIDDLE))}
#: The order of the parts (0 prefix, 1 middle, 2 suffix), each behind its sentinel, by form.
ARRANGEMENTS: dict[str, list[tuple[bytes, int]]] = {
    "psm": [(PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)],
    "spm": [(SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)],
}


class PieceTable:
    def __init__(self, text: bytes, pieces: list[Descriptor] | None = None):
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [(0, 0, len(text))] if pieces is None else pieces

    def cut(self, places: list[int]) -> PieceTable:
        """Split so that a descriptor ends at each of these (ascending) places of the whole; equal places
        give empty descriptors."""
        out, at, todo = [], 0, list(places)
        for buffer, start, stop in self.pieces:
            end = at + stop - start
            while todo and todo[0] <= end:
                edge = start + todo.pop(0) - at
                out.append((buffer, start, edge))
                at, start = at + edge - start, edge
            out.append((buffer, start, stop))
            at = end
        return PieceTable(self.buffers[0].obj, out)

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix (three descriptors) in the order of ``form``, with sentinels."""
        return PieceTable(self.buffers[0].obj, [d for mark, part in ARRANGEMENTS[form] for d in (_MARKS[mark], self.pieces[part])])

    def restored(self, form: str) -> PieceTable:
        """The inverse of ``arranged``: sentinels go, the parts go back."""
        back = {part: i for i, (_, part) in enumerate(ARRANGEMENTS[form])}
        return PieceTable(self.buffers[0].obj, [self.pieces[2 * back[part] + 1] for part in range(3)])

    def stretches(self) -> Iterator[memoryview]:
        for buffer, start, stop in self.pieces:
            yield self.buffers[buffer][start:stop]

    def read(self) -> bytes:
        return b"".join(self.stretches())

    def sha256(self) -> str:
        found = hashlib.sha256()
        for part in self.stretches():
            found.update(part)
        return found.hexdigest()


def count_units(text: bytes) -> int:
    """Tokens: each word with the white space before it, and white space at the end."""
    return len(text.split()) + (text[-1:] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))


def unit_end(text: bytes, units: int) -> int:
    """Where so many tokens end."""
    if units == 0:
        return 0
    parts = text.split(None, units)
    if len(parts) < units:  # the last token is the white space at the end
        return len(text)
    if len(parts) == units:
        return len(text.rstrip(_SPACES))
    return len(text[: len(text) - len(parts[units])].rstrip(_SPACES))


def plan(doc_id: int | None, text: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, list[int]]:
    """The number of tokens, the form, and where prefix and middle end in bytes (none for a plain text)."""
    n = count_units(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in _MARKS) or h3 % 100 >= rate:
        return n, "plain", []
    return n, "spm" if h4 % 100 < spm_rate else "psm", [unit_end(text, k) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]


def restore(output: bytes, form: str) -> PieceTable:
    """The text of an output, as descriptors over the output: cut at its sentinels and put back. Texts
    with a sentinel of their own are always plain, so each sentinel stands once."""
    whole = PieceTable(output)
    if form == "plain":
        return whole
    places, at = [], 0
    for mark, _ in ARRANGEMENTS[form]:
        at = output.index(mark, at)
        places += [at, at + len(mark)]
        at += len(mark)
    return PieceTable(output, whole.cut(places).pieces[1:]).restored(form)


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()), T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType()),
])


def fill_in_middle(
    df: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, outputs: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars[, output], output_sha256, restored_sha256) for every row.

    ``rate`` of 100 texts are arranged, ``spm_rate`` of 100 of these with the suffix first. A null text is
    an empty one: plain. A null id counts as no digits. Repeated rows give equal rows; other columns
    aren't read. An empty table gives no rows.
    """
    names = [n for n in _OUT.names if outputs or n != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 8 << 20):
            rows = []
            for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                n, form, places = plan(doc, raw, seed, rate, spm_rate)
                cut = PieceTable(raw).cut(places) if places else PieceTable(raw)
                arranged = cut if form == "plain" else cut.arranged(form)
                output = arranged.read()
                chars = [None, None] if form == "plain" else [len(str(p, "utf-8")) for p in list(cut.stretches())[:2]]
                rows.append((doc, n, form, *chars, *([output.decode()] if outputs else []), arranged.sha256(), restore(output, form).sha256()))
            types = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(c, types[_OUT[m].dataType]) for c, m in zip(zip(*rows, strict=True), names, strict=True)], names=names)

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([_OUT[n] for n in names]))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir), outputs=False)


#: Tokens are taken by the pattern itself; the restored text is cut out of the output again.
ORACLE_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT)) AS hs FROM a),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS x, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, array_to_string(u[1:x], '') AS p, array_to_string(u[x + 1:y], '') AS m, array_to_string(u[y + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM d"""
