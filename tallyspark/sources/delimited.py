"""Delimited text ledgers.

Everything is read as ``string`` (never inferred) and carries two extra
columns: ``_row``, the file order (``monotonically_increasing_id`` taken in
the scan, so it increases along each file), and ``_src``, the file name.

Each file has its own encoding, delimiter and header. One scan on the
executors looks at every line of every file (is it valid UTF-8, may a quote
stay open) and reads the header where it lies; one row a file comes to the
driver. Files that are alike are read together, and the parts are united by
column name, or by what a layout makes of the names (:func:`read_exports`).

Files without quoted line ends are read by Spark's CSV reader. Of the others each
block of lines is seen as a function from "starts inside a quoted field" to "ends
inside one"; composing these along a file tells where each block starts, and
then all blocks cut their records side by side (:func:`_records`).
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, groupby
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW, SRC, EXTRA = "_row", "_src", "_extra"
SAMPLE_LINES = 50
DELIMITERS = ",;\t|"
# Text that pandas reads as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _file_name() -> Column:
    """The file's name as it was given: the metadata column has blanks and the like as %20."""
    return F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias(SRC)


def _text(spark: SparkSession, path) -> DataFrame:
    """Lines as they are, with their file and their order in it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), _file_name(),
                                        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias(ROW))


#: A quoted field that ends where it should, whatever the delimiter.
_WHOLE_FIELD = re.compile(rb'(^|[,;\t|])"[^"]*(?:""[^"]*)*"(?=[,;\t|]|$)')


def survey_files(spark: SparkSession, path, n: int = SAMPLE_LINES, sep: str | None = None, header_row: int | None = None,
                 known_names=None, min_hits: int = 5) -> dict[str, dict]:
    """Of each file its ``encoding`` (UTF-8 if every line is valid UTF-8, else
    Latin-1), whether some line has a quote that may stay open (``quotes``), and from its first ``n``
    lines the ``delim``, the header's line ``hdr`` and its ``names``. One row a file comes to the driver."""
    known = None if known_names is None else sorted(known_names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a block: the lines of a block follow one another in one task."""
        block, latin, quotes, head = None, False, False, []

        def fact():
            return pa.RecordBatch.from_pylist([{"file": block[0], "latin": latin, "quotes": quotes, "head": head}], schema=schema)

        schema = pa.schema([("file", pa.string()), ("latin", pa.bool_()), ("quotes", pa.bool_()), ("head", pa.list_(pa.binary()))])
        for batch in batches:
            files, starts, values = (batch.column(c) for c in ("_file", "_start", "value"))
            # lines of one block follow one another: look at them together
            at, n_rows = 0, batch.num_rows
            changes = np.flatnonzero((np.diff(starts.to_numpy()) != 0) | (np.diff(files.dictionary_encode().indices.to_numpy()) != 0)) + 1
            for end in [*changes.tolist(), n_rows]:
                if end == at:  # an empty batch
                    continue
                file, start, lines = files[at].as_py(), starts[at].as_py(), values.slice(at, end - at)
                at = end
                if (file, start) != block:
                    if block is not None:
                        yield fact()
                    block, latin, quotes, head = (file, start), False, False, []
                if start == 0 and len(head) < n:
                    head.extend(lines.slice(0, n - len(head)).to_pylist())
                if not latin:
                    try:
                        lines.cast(pa.string())  # valid UTF-8 only
                    except pa.ArrowInvalid:
                        latin = True
                if not quotes:
                    quotes = any(b'"' in _WHOLE_FIELD.sub(rb"\1", v) for v in lines.filter(pc.match_substring(lines, '"')).to_pylist())
        if block is not None:
            yield fact()

    @F.pandas_udf("delim string, hdr int, names array<string>")
    def read_head(heads: pd.Series, latin: pd.Series) -> pd.DataFrame:
        out = []
        for raw, old in zip(heads, latin, strict=True):
            head = [bytes(x).decode("latin-1" if old else "utf-8") for x in ([] if raw is None else raw)]
            head[:1] = [h.lstrip("\ufeff") for h in head[:1]]
            hdr = header_row or 0
            if known is not None and header_row is None:
                hdr = header_row_of(head, known, min_hits, sep=sep) or 0
            delim = sep or sniff_delimiter(head[hdr:])
            out.append((delim, hdr, unique_names(split_line(head[hdr], delim)) if len(head) > hdr else []))
        return pd.DataFrame(out, columns=["delim", "hdr", "names"])

    lines = _text(spark, path).select(F.col("value").cast("binary").alias("value"), "_file", "_start")
    facts = (lines.mapInArrow(look, "file string, latin boolean, quotes boolean, head array<binary>").groupBy("file")
                  .agg(F.bool_or("latin").alias("latin"), F.bool_or("quotes").alias("quotes"), F.max(F.when(F.size("head") > 0, F.col("head"))).alias("head")))
    out = {unquote(r["file"]): {"encoding": "ISO-8859-1" if r["latin"] else "UTF-8", "quotes": r["quotes"], "delim": r["f"]["delim"],
                       "hdr": r["f"]["hdr"], "names": tuple(r["f"]["names"])}
           for r in facts.select("file", "latin", "quotes", read_head("head", "latin").alias("f")).collect()}
    if not out and not spark.read.text(path).inputFiles():
        raise FileNotFoundError(str(path))
    return out


def head_lines(spark: SparkSession, path: str, n: int = SAMPLE_LINES) -> list[str]:
    """First ``n`` lines of the first file by name."""
    files = spark.read.text(path).inputFiles()
    if not files:
        return []
    raw = [bytes(r["value"]) for r in _text(spark, unquote(min(files))).where("_start = 0").select(F.col("value").cast("binary").alias("value")).limit(n).collect()]
    try:
        head = [x.decode() for x in raw]
    except UnicodeDecodeError:
        head = [x.decode("latin-1") for x in raw]
    return [h.lstrip("\ufeff") if i == 0 else h for i, h in enumerate(head)]


def sniff_delimiter(lines: list[str], default: str = ",") -> str:
    sample = "\n".join(ln for ln in lines if ln.strip())
    if not sample:
        return default
    try:
        found = csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        found = None
    first = sample.split("\n", 1)[0]
    if found is None or found not in first:  # decimal commas below a header of ";" and the like
        counts = {d: first.count(d) for d in DELIMITERS}
        found = max(counts, key=counts.get)
    return found if found in first else default


def split_line(line: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(line.lstrip("﻿")), delimiter=sep), [])


def unique_names(names: list[str]) -> list[str]:
    """Blank names → ``Unnamed: i``; repeated names get ``.1``, ``.2`` …
    (the names pandas gives)."""
    out, seen = [], {}
    for i, n in enumerate(names):
        n = n.strip() or f"Unnamed: {i}"
        base = n
        while n in seen:
            seen[base] += 1
            n = f"{base}.{seen[base]}"
        seen.setdefault(n, 0)
        out.append(n)
    return out


def _na_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[
        (F.when(F.col(f"`{c}`").isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(f"`{c}`"))
         .alias(c) if c in cols else F.col(f"`{c}`")) for c in df.columns])


def read_delimited(spark: SparkSession, path, sep: str | None = None, encoding: str | None = None,
                   keep_bad: bool = False, na_to_null: bool = True, header_row: int | None = None,
                   known_names=None, min_hits: int = 5, counted: Observation | None = None) -> DataFrame:
    """Read delimited text as all-string columns.

    * ``sep`` / ``encoding``: decided for each file when None (delimiter among
      ``, ; tab |`` from its first lines; UTF-8 if all of it is, else
      Latin-1). A UTF-8 BOM is dropped.
    * Columns are matched by name over the files, in the order of the first
      file by name; files with other names are an error that says which
      (:func:`read_exports` reads those through a layout).
    * Quoted fields may hold line ends, in files of any size and below banners: the blocks of
      a file are still read by many tasks. A quote opens a field only at its
      start, so inch marks stay as they are. A quoted field that never ends is an error.
    * Short rows are padded with NULLs; rows with *more* fields than the
      header are malformed: dropped, or kept with ``_extra`` set when
      ``keep_bad`` (see :func:`bad_row_count`).
    * ``counted``: an ``Observation`` that gets ``rows`` and ``skipped_rows`` of the scan
      when an action runs, without a second read.
    * ``na_to_null``: pandas' default missing-value tokens become NULL.
    * ``header_row``: index of the header line when banner lines precede it in
      every file; with ``known_names`` it is looked for in each file
      (:func:`header_row_of`).
    """
    parts, order = [], None
    for files, names, part in _parts(spark, path, sep, encoding, header_row, known_names, min_hits):
        order = order or names
        if set(names) != set(order):
            raise ValueError(f"{files[0]} has other columns than the first file: {sorted(set(names) ^ set(order))}")
        parts.append(part.select(*[F.col(f"`{c}`") for c in order], EXTRA, ROW, SRC))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(ROW, T.LongType()), T.StructField(SRC, T.StringType())]))
    df = _united(parts)
    return _finished(df, order, keep_bad, na_to_null, counted)


def read_exports(spark: SparkSession, path, layout, extra: Sequence[str] = (), period: tuple[dt.date, dt.date] | None = None, period_days: int = 0,
                 sep: str | None = None, encoding: str | None = None, keep_bad: bool = False, na_to_null: bool = True,
                 header_row: int | None = None, known_names=None, min_hits: int = 5, counted: Observation | None = None) -> DataFrame:
    """M2/M7 over a folder of exports that differ: the columns of each kind of file are brought to
    the canonical ones of ``layout`` (aliases, fallbacks, defaults) before the
    parts are united, so one file's header doesn't bind another. ``extra``: further
    columns to keep where a file has them (else NULL). A file without a
    required column is an error that names it.

    ``period``: files whose names give a quarter (F18) that ends before, or with ``period_days`` later
    than its end starts after, that period are left out before anything of them but the survey is read;
    files without a quarter in their name stay. The rest as in :func:`read_delimited`.
    """
    from tallyspark.functions.dates import extend_period, quarter_from_name
    from tallyspark.plans.layout import MissingColumnsError, apply_layout

    def wanted(file: str) -> bool:
        own = extend_period(quarter_from_name(file.rsplit("/", 1)[-1]), period_days)
        return period is None or own is None or (own[0] <= period[1] and period[0] <= own[1])

    parts, columns = [], list(dict.fromkeys([*layout.required, *layout.defaults, *extra]))
    for files, names, part in _parts(spark, path, sep, encoding, header_row, known_names, min_hits, wanted):
        part = _na_to_null(part, names) if na_to_null else part
        try:
            part = apply_layout(part, layout)
        except MissingColumnsError as e:
            raise MissingColumnsError(f"{files[0]}: {layout.missing_message}", e.missing) from None
        here = [F.col(f"`{c}`") if c in part.columns else F.lit(None).cast("string").alias(c) for c in columns]
        parts.append(part.select(*here, EXTRA, ROW, SRC))
    if not parts:
        fields = [T.StructField(c, T.StringType()) for c in columns]
        return spark.createDataFrame([], T.StructType([*fields, T.StructField(ROW, T.LongType()), T.StructField(SRC, T.StringType())]))
    return _finished(_united(parts), columns, keep_bad, False, counted)


def _united(parts: list[DataFrame]) -> DataFrame:
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df


def _finished(df: DataFrame, names: list[str], keep_bad: bool, na_to_null: bool, counted: Observation | None) -> DataFrame:
    if counted is not None:
        df = df.observe(counted, F.count(F.lit(1)).alias("rows"), F.count(EXTRA).alias("skipped_rows"))
    if na_to_null:
        df = _na_to_null(df, names)
    return df if keep_bad else df.where(F.col(EXTRA).isNull()).drop(EXTRA)


def _parts(spark: SparkSession, path, sep, encoding, header_row, known_names, min_hits, wanted=None) -> Iterator[tuple[list[str], list[str], DataFrame]]:
    """Files that are alike, their column names and their rows, in the order of the first file by name."""
    alike = defaultdict(list)
    for file, fact in sorted(survey_files(spark, path, SAMPLE_LINES, sep, header_row, known_names, min_hits).items()):
        if fact["names"] and (wanted is None or wanted(file)):  # an empty file has no columns and no rows
            alike[encoding or fact["encoding"], fact["quotes"], fact["delim"], fact["hdr"], fact["names"]].append(file)
    for (enc, quotes, delim, hdr, names), files in alike.items():
        yield files, list(names), _read_alike(spark, files, enc, quotes, delim, hdr, list(names))


def _read_alike(spark: SparkSession, files: list[str], enc: str, quotes: bool, delim: str, hdr: int, names: list[str]) -> DataFrame:
    """Files of one encoding, delimiter and header."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, EXTRA]])
    opts = {"sep": delim, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if hdr == 0 and not quotes:
        df = spark.read.schema(schema).options(header="true", encoding=enc, **opts).csv(files)
        return df.select("*", F.monotonically_increasing_id().alias(ROW), _file_name())
    lines = _text(spark, files)
    if enc != "UTF-8":
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), enc))
    kept = _records(lines, delim, hdr) if quotes else _below_header(lines, hdr)
    ddl = ", ".join(f"`{n}` string" for n in [*names, EXTRA])
    parsed = F.from_csv("value", ddl, {k: v for k, v in opts.items() if k != "mode"})
    return kept.where(F.btrim("value") != "").select(parsed.alias("_r"), ROW, SRC).select("_r.*", ROW, SRC)


def _below_header(lines: DataFrame, hdr: int) -> DataFrame:
    """Without each file's first ``hdr + 1`` lines, which stand in its first block."""
    first = F.broadcast(lines.where("_start = 0").groupBy("_file").agg(F.min(ROW).alias("_first")))  # a row a file
    return lines.join(first, "_file", "left").where((F.col("_start") > 0) | (F.col(ROW) - F.col("_first") > hdr))


def ends_open(line: str, delim: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, given whether one is at its start. A quote opens a
    field only at the field's start; within it two quotes are one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            at, inside = at + 1, True
        while inside:
            at = line.find('"', at)
            if at < 0:
                return True
            inside = line.startswith('"', at + 1)
            at += 2 if inside else 1
        at = line.find(delim, at)
        if at < 0:
            return False
        at += len(delim)


def _records(lines: DataFrame, delim: str, hdr: int) -> DataFrame:
    """Lines joined to records, line ends within quoted fields kept (as ``\\n``), without the first
    ``hdr + 1`` lines of each file: ``value, _row, _src``.

    Every block of a file maps "inside a quoted field" at its start to the same at its end. The
    blocks' maps are composed in the order of the file, in a window of one small row a block. Then
    each block cuts its lines; only the pieces of records that go over a block's end, two a block at most, are put together by a shuffle.
    """
    columns = ["value", "_file", "_start", ROW, SRC]

    def blocks(batches: Iterator[pa.RecordBatch], more: Sequence[str] = ()) -> Iterator[tuple[dict, Iterator[tuple[str, int]]]]:
        """Each block's facts and its lines below the header with their numbers; to be read in turn."""
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in [*columns, *more]), strict=True)

        for _, found in groupby(rows(), key=lambda r: (r[1], r[2])):
            first = next(found)
            fact = dict(zip([*columns, *more], first, strict=True))

            def body(first=first, found=found):
                skip = hdr + 1 if first[2] == 0 else 0
                for i, r in enumerate(chain([first], found)):
                    if i >= skip:
                        yield r[0], r[3]

            yield fact, body()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fact, body in blocks(batches):
            end = [False, True]
            for value, _ in body:
                end = [ends_open(value, delim, end[0]), ends_open(value, delim, end[1])] if '"' in value else end
            yield pa.RecordBatch.from_pylist([{"_file": fact["_file"], "_start": fact["_start"], "open0": end[0], "open1": end[1]}])

    ends = lines.select(*columns).mapInArrow(maps, "_file string, _start long, open0 boolean, open1 boolean")
    # a block that ends alike from either start forgets what was before it; one that turns the state round counts as a turn
    upto = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("_file").orderBy("_start")
    same, turn = F.col("open0") == F.col("open1"), F.col("open0") & ~F.col("open1")
    state = ends.withColumn("_turns", F.sum(turn.cast("int")).over(along)).withColumn("_set", F.when(same, F.struct("open0", "_turns")))
    state = state.withColumn("_last", F.last("_set", ignorenulls=True).over(upto)).withColumn("_before", F.coalesce(F.lag("_turns").over(along), F.lit(0)))
    turned = (F.col("_before") - F.coalesce(F.col("_last._turns"), F.lit(0))) % 2 == 1
    state = state.select("_file", "_start", (F.coalesce(F.col("_last.open0"), F.lit(False)) != turned).alias("inside"), "open0", "open1")
    last = Window.partitionBy("_file").orderBy(F.desc("_start"))
    never = state.withColumn("_n", F.row_number().over(last)).where((F.col("_n") == 1) & F.when(F.col("inside"), F.col("open1")).otherwise(F.col("open0")))
    unclosed = [r["_file"] for r in never.select("_file").limit(3).collect()]
    if unclosed:
        raise ValueError(f"a quoted field never ends in {', '.join(unclosed)}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``part``: w a whole record, h the end of one that began earlier, t the start of one that goes on, m neither end."""
        for fact, body in blocks(batches, ["inside"]):
            inside, earlier, held, row, out = fact["inside"], fact["inside"], [], None, []
            for value, number in body:
                row = number if not held else row
                held.append(value)
                inside = ends_open(value, delim, inside)
                if not inside:
                    out.append(("h" if earlier else "w", "\n".join(held), row))
                    held, earlier = [], False
                    if len(out) >= 5000:
                        yield batch_of(fact, out)
                        out = []
            if held:
                out.append(("m" if earlier else "t", "\n".join(held), row))
            if out:
                yield batch_of(fact, out)

    def batch_of(fact: dict, out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"_file": fact["_file"], SRC: fact[SRC], "_start": fact["_start"], "part": p, "value": v, ROW: r} for p, v, r in out])

    # the planner picks the join by the size of the small side; the sort gives each block's lines their order back
    begun = lines.select(*columns).join(state.select("_file", "_start", "inside"), ["_file", "_start"])
    begun = begun.select(*columns, "inside").sortWithinPartitions("_file", "_start", ROW)
    found = begun.mapInArrow(cut, f"_file string, {SRC} string, _start long, part string, value string, {ROW} long")
    whole = found.where("part = 'w'").select("value", ROW, SRC)
    # a piece that begins a record opens a group, which the pieces up to its end join
    record = F.sum((F.col("part") == "t").cast("int")).over(Window.partitionBy("_file").orderBy("_start", ROW))
    pieces = found.where("part <> 'w'").withColumn("_record", record)
    stitched = pieces.groupBy("_file", SRC, "_record").agg(F.array_sort(F.collect_list(F.struct(ROW, "value"))).alias("_p"))
    stitched = stitched.select(F.array_join(F.col("_p.value"), "\n").alias("value"), F.col("_p")[0][ROW].alias(ROW), SRC)
    return whole.unionByName(stitched)


def bad_row_count(df_with_extra: DataFrame) -> DataFrame:
    """One row ``skipped_rows``: rows with more fields than the header."""
    return df_with_extra.agg(F.sum(F.when(F.col(EXTRA).isNotNull(), 1).otherwise(0))
                             .cast("bigint").alias("skipped_rows"))


def header_row_of(head: list[str], known_names, min_hits: int = 5, probe_rows: int = 25, sep: str | None = None) -> int | None:
    """0 if the first line names any column; else the first of the first
    ``probe_rows`` lines holding at least ``min_hits`` known column names
    (compared stripped and upper-cased), or None."""
    delim = sep or sniff_delimiter(head)
    names = split_line(head[0], delim) if head else []
    if any(n.strip() and not n.strip().lower().startswith("unnamed") for n in names):
        return 0
    wanted = {str(x).strip().upper() for x in known_names}
    for i, ln in enumerate(head[:probe_rows]):
        vals = {v.strip().upper() for v in split_line(ln, delim) if v.strip()}
        if len(vals & wanted) >= min_hits:
            return i
    return None


def find_header_row(spark: SparkSession, path: str, known_names, min_hits: int = 5,
                    probe_rows: int = 25, sep: str | None = None) -> int | None:
    """Index of the header line of the first file by name, banner or not."""
    head = head_lines(spark, path)
    delim = sep or sniff_delimiter(head)
    wanted = {str(x).strip().upper() for x in known_names}
    hits = (i for i, ln in enumerate(head[:probe_rows])
            if len({v.strip().upper() for v in split_line(ln, delim) if v.strip()} & wanted) >= min_hits)
    return next(hits, None)


def read_flexible(spark: SparkSession, path: str, known_names, min_hits: int = 5, **kw) -> DataFrame:
    """A normal header when any header name is real; otherwise the header
    line is looked for among the first 25 lines, in each file."""
    return read_delimited(spark, path, known_names=known_names, min_hits=min_hits, **kw)


def select_columns(df: DataFrame, names) -> DataFrame:
    """Projection with an explicit error naming missing columns; the
    projection reaches the scan (column pruning)."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"Colonne mancanti: {', '.join(missing)}")
    extra = [c for c in (ROW, SRC) if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in names], *extra)


def raw_line_count(spark: SparkSession, path: str) -> int:
    """Physical lines of a raw file minus the header line."""
    return spark.read.text(path).count() - 1
