"""Spreadsheet ledgers.

Spark has no Excel reader and no Excel library is available, so workbooks
are parsed with the standard library (``zipfile`` + streamed XML). Cells
come back as text, as the source reads them (``dtype=str``): numbers as
written in the cell, dates (cells with a date number format) as
``yyyy-MM-dd HH:mm:ss``.

:func:`read_xlsx` is the cluster path: ``binaryFile`` reads the workbooks
from any filesystem Spark reads and each workbook is parsed inside its task
(``mapInPandas``); a folder of workbooks is parsed in parallel. This is an
ingest helper beside the operators: a workbook is parsed by one task.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from xml.etree import ElementTree as ET

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
_M = "{%s}" % NS["m"]
# Built-in number formats that show dates (ECMA-376 numbering).
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
EXCEL_EPOCH = dt.datetime(1899, 12, 30)


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_path(z: zipfile.ZipFile, sheet: str | None) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = wb.findall("m:sheets/m:sheet", NS)
    if not sheets:
        raise ValueError("workbook without sheets")
    chosen = sheets[0]
    if sheet is not None:
        match = [s for s in sheets if s.get("name") == sheet]
        if not match:
            raise ValueError(f"Worksheet named '{sheet}' not found")
        chosen = match[0]
    rid = chosen.get("{%s}id" % NS["r"])
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for r in rels.findall("rel:Relationship", NS):
        if r.get("Id") == rid:
            target = r.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    raise ValueError("sheet relationship not found")


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(_M + "t")) for si in root.findall("m:si", NS)]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {}
    for nf in root.findall("m:numFmts/m:numFmt", NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", "")).lower()
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[dy]", code)) or "mm/" in code
    out = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in DATE_FORMAT_IDS or custom.get(fid):
            out.add(i)
    return out


def iter_rows(path, sheet: str | None = None):
    """Yield each sheet row as a list of text cells (None for empty).
    ``path`` is a file name or a binary file object (workbook bytes)."""
    with zipfile.ZipFile(path) as z:
        strings = _shared_strings(z)
        dates = _date_styles(z)
        with z.open(_sheet_path(z, sheet)) as fh:
            for _, el in ET.iterparse(fh, events=("end",)):
                if el.tag != _M + "row":
                    continue
                cells: dict[int, str | None] = {}
                for c in el.findall("m:c", NS):
                    idx = _col_index(c.get("r")) if c.get("r") else len(cells)
                    t = c.get("t")
                    v = c.find("m:v", NS)
                    if t == "inlineStr":
                        val = "".join(x.text or "" for x in c.iter(_M + "t"))
                    elif v is None or v.text is None:
                        val = None
                    elif t == "s":
                        val = strings[int(v.text)]
                    elif t == "b":
                        val = "True" if v.text == "1" else "False"
                    elif t in ("str", "e"):
                        val = v.text
                    elif c.get("s") and int(c.get("s")) in dates:
                        stamp = EXCEL_EPOCH + dt.timedelta(days=float(v.text))
                        val = stamp.strftime("%Y-%m-%d %H:%M:%S")
                    else:
                        val = v.text
                        if re.fullmatch(r"-?\d+\.0", val):
                            val = val[:-2]
                    cells[idx] = val
                el.clear()
                width = max(cells) + 1 if cells else 0
                yield [cells.get(i) for i in range(width)]


def header_of(path: str, sheet: str | None = None, header_row: int = 0) -> list[str]:
    for i, row in enumerate(iter_rows(path, sheet)):
        if i == header_row:
            return [("" if v is None else str(v)).strip() for v in row]
    return []


def read_xlsx(spark, path: str, sheet: str | None = None, header_row: int = 0):
    """Workbooks at ``path`` (file, folder or glob, on any filesystem Spark
    reads: local, HDFS, object stores) as all-string rows plus ``_row`` and
    ``_src``.

    ``binaryFile`` gives one row per workbook (its bytes), read by the
    executors; each workbook is parsed inside its task (``mapInPandas``).
    Columns are those of the first workbook by path, whose header alone reaches
    the driver; others are matched by name, and other names are an error.
    """
    import io

    import pandas as pd
    from pyspark.sql import functions as F

    from tallyspark.sources.delimited import unique_names

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path)
             .select("path", "content"))

    def header(batches):
        for pdf in batches:
            for content in pdf["content"]:
                names = header_of(io.BytesIO(content), sheet, header_row)
                yield pd.DataFrame({"name": names})
                return

    first = files.agg(F.min("path")).first()[0]  # paths alone are read
    names = unique_names([r.name for r in files.where(F.col("path") == first).mapInPandas(header, "name string").collect()])
    if not names:
        raise ValueError(f"no header found in {path}")
    width = len(names)
    ddl = ", ".join(f"`{n}` string" for n in names) + ", _row bigint, _src string"

    def parse(batches):
        for pdf in batches:
            for src, content in zip(pdf["path"], pdf["content"]):
                rows = []
                own = unique_names(header_of(io.BytesIO(content), sheet, header_row))
                if set(own) != set(names):
                    raise ValueError(f"{src} has other columns than the first workbook: {sorted(set(own) ^ set(names))}")
                at = [own.index(n) for n in names]
                for i, row in enumerate(iter_rows(io.BytesIO(content), sheet)):
                    if i <= header_row or all(v is None or str(v).strip() == "" for v in row):
                        continue
                    row = (row + [None] * width)[:width]
                    rows.append([row[k] for k in at] + [i, src])
                yield pd.DataFrame(rows, columns=names + ["_row", "_src"]).astype(
                    {**{n: "object" for n in names}, "_row": "int64", "_src": "object"})

    out = files.mapInPandas(parse, ddl)
    return out.withColumn("_src", F.regexp_extract("_src", r"([^/]+)$", 1))


def write_xlsx(path: str, header: list[str], rows: list[list], sheet: str = "Sheet1") -> None:
    """Minimal workbook writer (inline strings, one sheet) used to build
    test fixtures; numbers given as int/float are written as numbers."""
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        s = (str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{s}</t></is></c>'

    def ref(ci, ri):
        name, n = "", ci + 1
        while n:
            n, rem = divmod(n - 1, 26)
            name = chr(65 + rem) + name
        return f"{name}{ri}"

    body = []
    for ri, r in enumerate([header] + rows, start=1):
        body.append(f'<row r="{ri}">' + "".join(cell(ref(ci, ri), v) for ci, v in enumerate(r)) + "</row>")
    sheet_xml = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                 f'<worksheet xmlns="{NS["m"]}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    wb = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
          f'<workbook xmlns="{NS["m"]}" xmlns:r="{NS["r"]}"><sheets>'
          f'<sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
    rels = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            f'<Relationships xmlns="{NS["rel"]}"><Relationship Id="rId1" '
            'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>')
    ct = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
          '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
          '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
          '<Default Extension="xml" ContentType="application/xml"/>'
          '<Override PartName="/xl/workbook.xml" '
          'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
          '<Override PartName="/xl/worksheets/sheet1.xml" '
          'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
          '</Types>')
    root_rels = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                 f'<Relationships xmlns="{NS["rel"]}"><Relationship Id="rId1" '
                 'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
                 'Target="xl/workbook.xml"/></Relationships>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", ct)
        z.writestr("_rels/.rels", root_rels)
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/worksheets/sheet1.xml", sheet_xml)
