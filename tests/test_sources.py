"""Sources: delimited text (G9), header search (G16), spreadsheets (S3)."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import jobs
from tallyspark.plans.layout import REGISTER_DEFAULTS, REGISTER_REQUIRED
from tallyspark.sources import (
    bad_row_count, find_header_row, raw_line_count, read_delimited, read_flexible, read_ledger, select_columns,
    write_xlsx,
)


def _write(path, text, encoding="utf-8"):
    with open(path, "wb") as fh:
        fh.write(text.encode(encoding))
    return path


def test_csv_short_long_rows_bom_semicolon_g9(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "a.csv"), "﻿name;amount;id\nAcme;1.234,56;7\nShort;5\nLong;1;2;3\nÈlite;2;\n")
    raw = read_delimited(spark, p, keep_bad=True)
    assert bad_row_count(raw).first().skipped_rows == 1
    df = read_delimited(spark, p)
    rows = [(r["name"], r["amount"], r["id"]) for r in df.orderBy("_row").collect()]
    assert rows == [("Acme", "1.234,56", "7"), ("Short", "5", None), ("Èlite", "2", None)]
    assert df.columns[:3] == ["name", "amount", "id"]
    assert raw_line_count(spark, p) == 4


def test_csv_latin1_and_na_tokens(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "b.csv"), "name,code\nCaffè,NULL\nnan,x\n", encoding="latin-1")
    rows = [(r["name"], r["code"]) for r in read_delimited(spark, p).orderBy("_row").collect()]
    assert rows == [("Caffè", None), (None, "x")]


def test_header_search_g16(spark, tmpdir_path):
    cols = list(REGISTER_REQUIRED)
    body = ",".join(cols) + "\n" + ",".join(["v"] * len(cols)) + "\n"
    p = _write(os.path.join(tmpdir_path, "c.csv"), ",,,\nREPORT,,\n,,,\n" + body)
    assert find_header_row(spark, p, set(REGISTER_REQUIRED) | set(REGISTER_DEFAULTS)) == 3
    df = read_flexible(spark, p, set(REGISTER_REQUIRED) | set(REGISTER_DEFAULTS))
    assert df.count() == 1 and df.first()["C_NOME"] == "v"
    assert select_columns(df, ["C_NOME"]).columns[0] == "C_NOME"


def test_xlsx_roundtrip_and_job(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "paid.xlsx")
    write_xlsx(p, ["Ragione Sociale", "Numero fattura", "Identificativo SDI", "Data emissione", "Importo fattura"],
               [["R1", "n1", "", "2025-01-01", 10], ["R2", "n2", "55", "2025-01-02", 20.5]])
    df = read_ledger(spark, p)
    assert df.count() == 2 and df.orderBy("_row").first()["Ragione Sociale"] == "R1"
    s = jobs.portal_paid_report(df)["stats"].first()
    assert (s.paper_records, s.electronic_records, float(s.electronic_amount)) == (1, 1, 20.5)


def test_multi_file_first_row_is_file_order(spark, tmpdir_path):
    """Keep-first across several files: (file name, position) decides."""
    from tallyspark.plans.jobs import portal_paid_report
    d = os.path.join(tmpdir_path, "multi")
    os.makedirs(d)
    header = "Creditore,Numero fattura,Identificativo SDI,Data emissione,Importo fattura\n"
    _write(os.path.join(d, "a_small.csv"), header + "A,1,,2025-01-01,1\n")
    _write(os.path.join(d, "b_big.csv"), header + "".join(f"B,{i},,2025-01-01,1\n" for i in range(2000)))
    df = read_delimited(spark, d)
    out = portal_paid_report(df, max_rows=5000)["data"].collect()
    assert out[0]["Creditore"] == "A" and out[1]["Creditore"] == "B" and out[1]["Numero fattura"] == "0"


def test_files_of_one_folder_differ(spark, tmpdir_path):
    """Other column order, an accent far down, quoted line ends, a banner in each file."""
    d = os.path.join(tmpdir_path, "mixed")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), "a;b\n" + "x;1\n" * 100 + "Città;2\n", encoding="latin-1")
    _write(os.path.join(d, "b.csv"), "b,a\n3,è\n")
    _write(os.path.join(d, "c.csv"), 'a;b\n"two\nlines";4\n"say ""hi""";5\n')
    rows = [(r["a"], r["b"]) for r in read_delimited(spark, d).orderBy("_src", "_row").collect()]
    assert rows == [("x", "1")] * 100 + [("Città", "2"), ("è", "3"), ("two\nlines", "4"), ('say "hi"', "5")]
    _write(os.path.join(d, "d.csv"), "a;c\n1;2\n")
    with pytest.raises(ValueError, match="other columns"):
        read_delimited(spark, d)
    e = os.path.join(tmpdir_path, "banner")
    os.makedirs(e)
    cols = ["C_NOME", "FAT_DATDOC", "FAT_NDOC", "FAT_DATREG", "FAT_PROT"]
    for k in "ab":
        _write(os.path.join(e, f"{k}.csv"), ",,,,\n,,,,\n" + ",".join(cols) + "\n" + f"{k}1,,,,\n{k}2,,,,\n")
    got = read_flexible(spark, e, set(cols))
    assert sorted(r["C_NOME"] for r in got.collect()) == ["a1", "a2", "b1", "b2"]


def _small_blocks(spark, n):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return old


@pytest.fixture()
def small_blocks(spark):
    """Files are cut into blocks of 40 bytes, so that quoted fields go over many of them."""
    old = _small_blocks(spark, 40)
    yield 40
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("banner", [0, 3])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_quoted_line_ends_over_many_blocks(spark, tmpdir_path, small_blocks, banner, encoding):
    """Records that end in the block of their start, a few blocks later, and many; quotes that open nothing."""
    import csv
    import io
    import random
    rng = random.Random(banner)
    cells = ["x", "", "plain text", "two\nlines", "a\n\nb\n", '"', '""', 'say "hi"\nthere; you', "Città\n", ";", "long " * 30, "many\n" * 40, "5 in"]
    rows = [[str(i), rng.choice(cells), rng.choice(cells), "end"] for i in range(300)]
    out = io.StringIO()
    for _ in range(banner):
        out.write(";;;\n")
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerow(["C_NOME", "FAT_NDOC", "FAT_PROT", "IMPONIBILE"])
    for i, row in enumerate(rows):
        if i % 7 == 0:  # marks in the middle of a field, written as they are
            row[1], row[2] = '5" pipe', 'x "q" y"'
            out.write(";".join(row) + "\n")
        else:
            writer.writerow(row)
    p = _write(os.path.join(tmpdir_path, "q.csv"), out.getvalue(), encoding)
    assert os.path.getsize(p) > 100 * small_blocks
    df = read_flexible(spark, p, {"C_NOME", "FAT_NDOC", "FAT_PROT", "IMPONIBILE"}, min_hits=4, na_to_null=False)
    assert len(spark.read.text(p).select(F.spark_partition_id()).distinct().collect()) > 20  # many tasks
    got = [[r[c] or "" for c in ("C_NOME", "FAT_NDOC", "FAT_PROT", "IMPONIBILE")] for r in df.orderBy("_row").collect()]
    assert got == rows


def test_quoted_field_that_never_ends(spark, tmpdir_path, small_blocks):
    p = _write(os.path.join(tmpdir_path, "open.csv"), "a;b\n1;2\n" * 20 + '3;"open\n' + "4;5\n" * 50)
    with pytest.raises(ValueError, match="never ends"):
        read_delimited(spark, p)


def test_state_of_a_line():
    from tallyspark.sources.delimited import ends_open
    closed = ["", "a;b", '"a";"b"', '5" x;y', 'a;"b""c"', '""', '"a"b"c;d', 'x "q" y"', '"a;b"']
    opened = ['"', 'a;"b', '"a""', 'a;"b;c', '"a";"', 'x;"y""z']
    assert not any(ends_open(x, ";", False) for x in closed) and all(ends_open(x, ";", False) for x in opened)
    assert ends_open("a;b", ";", True) and not ends_open('a";b', ";", True) and ends_open('a";"b', ";", True) and ends_open('a""', ";", True)


def test_folder_of_differing_exports(spark, tmpdir_path):
    """Each file through the layout on its own; a file that lacks a column is named."""
    from tallyspark.plans.layout import PORTAL_PAID, MissingColumnsError
    from tallyspark.sources import read_exports
    d = os.path.join(tmpdir_path, "kinds")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), "Ragione Sociale;C;Identificativo SDI;F;Importo fattura;Importo pagato\nR1;n1;7;2025-01-01;10;9\n")
    _write(os.path.join(d, "b 2.csv"), "Creditore,Numero fattura,Identificativo SDI,Data emissione,Importo fattura,other\nR2,n2,,2025-01-02,20,z\n")
    df = read_exports(spark, d, PORTAL_PAID, ["Importo pagato"])
    rows = [tuple(r[c] for c in ("Creditore", "Numero fattura", "Identificativo SDI", "Importo fattura", "Importo pagato", "_src")) for r in df.orderBy("_src").collect()]
    assert rows == [("R1", "n1", "7", "10", "9", "a.csv"), ("R2", "n2", None, "20", None, "b 2.csv")]
    assert "other" not in df.columns
    _write(os.path.join(d, "c.csv"), "Creditore;x\nR;1\n")
    with pytest.raises(MissingColumnsError, match="c.csv"):
        read_exports(spark, d, PORTAL_PAID)


def test_files_outside_the_period_are_not_read(spark, tmpdir_path):
    import datetime as dt
    from tallyspark.functions import parse_date
    from tallyspark.operators.filters import filter_file_period
    from tallyspark.plans.layout import PORTAL_PAID
    from tallyspark.sources import read_exports
    d = os.path.join(tmpdir_path, "quarters")
    os.makedirs(d)
    head = "Creditore;Numero fattura;Identificativo SDI;Data emissione;Importo fattura\n"
    for name, day in (("P I TRIM 2025", "2025-02-01"), ("P 2° trimestre 2025", "2025-05-01"), ("P IV TRIM. 2025", "2025-12-31"), ("other", "1999-01-01")):
        _write(os.path.join(d, name + ".csv"), head + f"R;n;;{day};1\nR;late;;2025-07-05;1\n")
    year = (dt.date(2025, 4, 1), dt.date(2025, 12, 1))
    df = read_exports(spark, d, PORTAL_PAID, period=year)
    assert sorted({r["_src"] for r in df.collect()}) == ["P 2° trimestre 2025.csv", "P IV TRIM. 2025.csv", "other.csv"]
    assert not any("P%20I%20TRIM" in f or "P I TRIM" in f for f in df.inputFiles())
    dated = df.withColumn("d", parse_date("Data emissione"))
    assert sorted((r["_src"][:4], r["Numero fattura"]) for r in filter_file_period(dated, "d").collect()) == [("P 2°", "n"), ("P IV", "n"), ("othe", "late"), ("othe", "n")]
    assert ("P 2°", "late") in {(r["_src"][:4], r["Numero fattura"]) for r in filter_file_period(dated, "d", days=8).collect()}


def test_skipped_rows_counted_by_the_scan(spark, tmpdir_path):
    from pyspark.sql import Observation
    p = _write(os.path.join(tmpdir_path, "o.csv"), "a;b\n1;2\n1;2;3\n4\n1;2;3;4\n")
    seen = Observation("scan")
    df = read_delimited(spark, p, counted=seen)
    assert df.count() == 2 and seen.get == {"rows": 4, "skipped_rows": 2}
