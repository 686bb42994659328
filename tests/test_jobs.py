"""End-to-end jobs on the reference's own fixtures (FIXTURES.md Fx1–Fx7,
G16, G17) and the invariants between result tables."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import jobs
from conftest import strings

# The fixtures of the end-to-end tests (FIXTURES.md).
FX1_HEADER = ["C_NOME", "FAT_DATDOC", "FAT_NDOC", "FAT_DATREG", "FAT_PROT", "FAT_NUM", "IMPONIBILE", "FAT_TOTFAT",
              "FAT_TOTIVA", "RA_IMPON", "RA_CODTRIB", "RA_IMPOSTA", "TMC_G8"]
FX1 = [["ACME Inc", "2025-01-01", "F001", "2025-01-01", "EP", "1", "100.0", "122.0", "22.0", "100.0", "I9", "5.0", "ID1"],
       ["Test Corp", "2025-01-02", "F002", "2025-01-02", "P", "2", "200.0", "244.0", "44.0", "200.0", "XX", "10.0", "ID2"],
       ["ACME Inc", "2025-01-01", "F001", "2025-01-01", "EP", "1", "100.0", "122.0", "22.0", "100.0", "RO", "5.0", "ID1"]]


def _with_order(df):
    return df.withColumn("_row", F.monotonically_increasing_id())


def test_register_dedup_fx1(spark):
    out = jobs.register_report(_with_order(strings(spark, FX1_HEADER, FX1)))
    s = out["stats"].first()
    assert (s.total_records, s.duplicates_removed, s.paper_records, s.electronic_records) == (2, 1, 1, 1)
    assert (s.paper_amount, s.electronic_amount) == (Decimal("200.00"), Decimal("100.00"))
    paper = {r.code: r.n for r in out["summary_paper"].collect()}
    assert paper["P"] == 1 and paper["2P"] == 0 and paper["TOTALE"] == 1
    assert out["data"].count() == 2
    assert out["data_total"].first().paid == Decimal("300.00")


def test_register_missing_columns_fx2(spark):
    with pytest.raises(ValueError, match="Colonne mancanti"):
        jobs.register_report(strings(spark, ["WRONG_COL"], [["x"]]))


def test_register_no_valid_code(spark):
    rows = [r[:4] + ["ZZ"] + r[5:] for r in FX1]
    with pytest.raises(ValueError, match="allowed protocol"):
        jobs.register_report(_with_order(strings(spark, FX1_HEADER, rows)))


def test_register_aliases_and_preferred_doc_g17(spark):
    header = ["Ragione Sociale", "Data Fattura", "N_FATTURE", "N_DOCUMENTO", "DATA_REG_FATTURA", "ft_prot",
              "N_PROTOCOLLO", "IMPONIBILE", "IMP_TOT_IVA", "IDENT_SDI"]
    rows = [["A", "2025-01-01", "X1", "D1", "2025-01-01", "p", "1", "1.234,50", "0", ""],
            ["A", "2025-01-01", "X2", "D1", "2025-01-01", "p", "2", "10", "0", ""]]
    out = jobs.register_report(_with_order(strings(spark, header, rows)))
    s = out["stats"].first()
    # N_DOCUMENTO wins as document number, so the two rows are duplicates
    assert (s.total_records, s.duplicates_removed, s.paper_amount) == (1, 1, Decimal("1234.50"))


FX3_HEADER = ["Creditore", "Numero fattura", "Identificativo SDI", "Data emissione", "Importo fattura", "Importo pagato"]
FX3 = [["Ragione A", "F001", "", "2025-01-10", "120.0", "100.0"],
       ["Ragione B", "F002", "123", "", "220.0", "200.0"],
       ["Ragione C", "F003", None, "2025-02-01", "320.0", "300.0"]]


def test_portal_paid_fx3(spark):
    out = jobs.portal_paid_report(strings(spark, FX3_HEADER, FX3))
    s = out["stats"].first()
    assert (s.total_records, s.paper_records, s.electronic_records) == (3, 2, 1)
    assert (s.paper_amount, s.electronic_amount) == (Decimal("400.00"), Decimal("200.00"))
    data = out["data"].collect()
    assert len(data) == 4 and data[-1]["Creditore"] == "TOTALE"
    assert data[-1]["Importo pagato"] == Decimal("600.00")


FX4_HEADER = ["Creditore", "Numero fattura", "Data emissione", "Data documento", "Data pagamento", "IVA",
              "Importo fattura", "Identificativo SDI"]
FX4 = [["Ragione A", "F001", "2025-01-10", "2025-01-10", "", "22,00", "122,00", ""],
       ["Ragione B", "F002", "2025-01-11", "2025-01-11", "", "44,00", "244,00", "123"],
       ["Ragione C", "F003", "2025-01-12", "2025-01-12", "", "0", "100", None]]


def test_portal_received_fx4_fx5(spark):
    out = jobs.portal_received_report(strings(spark, FX4_HEADER, FX4))
    s = out["stats"].first()
    assert (s.total_records, s.paper_records, s.electronic_records) == (3, 2, 1)
    assert (s.paper_amount, s.electronic_amount) == (Decimal("222.00"), Decimal("244.00"))
    taxable = sorted(r["Imponibile"] for r in out["data"].collect() if r["Ragione sociale"] != "TOTALE")
    assert taxable == [Decimal(100), Decimal(100), Decimal(200)]
    zero_ids = [r[:7] + [v] for r, v in zip(FX4, ["0,0", "0", "123"])]
    s5 = jobs.portal_received_report(strings(spark, FX4_HEADER, zero_ids))["stats"].first()
    assert (s5.paper_records, s5.electronic_records) == (0, 3)


def test_portal_received_missing(spark):
    with pytest.raises(ValueError, match="IVA"):
        jobs.portal_received_report(strings(spark, [c for c in FX4_HEADER if c != "IVA"], [["x"] * 7]))


def test_portal_received_period(spark):
    rows = [r[:4] + [p] + r[5:] for r, p in zip(FX4, ["2025-01-15", "2025-04-01", "bad"])]
    s = jobs.portal_received_report(strings(spark, FX4_HEADER, rows), "/x/Ricevute I TRIM 2025.xlsx")["stats"].first()
    assert s.total_records == 1


REG6_HEADER = ["C_NOME", "FAT_DATDOC", "FAT_NDOC", "DATA_REG_FATTURA", "FAT_PROT", "FAT_NUM", "IMPONIBILE",
               "FAT_TOTFAT", "FAT_TOTIVA", "RA_IMPON", "RA_CODTRIB", "RA_IMPOSTA", "TMC_G8"]
REG6 = [["A", "2025-01-05", "F001", "2025-01-10", "P", "1", "100.0", "122.0", "22.0", "100.0", "I9", "5.0", ""],
        ["B", "2025-01-15", "F002", "2025-01-20", "EP", "2", "200.0", "244.0", "44.0", "200.0", "RO", "10.0", "ID2"]]
POR6_HEADER = ["Identificativo SDI", "B", "C", "D", "E", "F", "G", "Creditore", "I", "Importo Fattura", "K",
               "Importo Pagato", "M", "N", "O"]


def _por6(rows):
    out = []
    for sdi, num, date, name, amt, paid in rows:
        out.append([sdi, "", num, "", "", date, "", name, "", amt, "", paid, "", "", ""])
    return out


POR6 = _por6([["", "c1", "2025-01-12", "Ragione A", "120.0", "150.0"],
              ["123", "c2", "2025-01-20", "Ragione B", "220.0", "250.0"],
              ["", "c_extra", "2025-01-25", "Ragione X", "50.0", "50.0"],
              ["", "c3", "2025-02-05", "Ragione C", "320.0", "300.0"]])


def test_compare_fx6_and_invariants(spark):
    out = jobs.compare_ledgers(_with_order(strings(spark, REG6_HEADER, REG6)),
                               _with_order(strings(spark, POR6_HEADER, POR6)))
    summ = {r.category: (r.a_n, r.a_amt, r.b_n, r.b_amt, r.delta_n, r.delta_amt) for r in out["summary"].collect()}
    assert summ["paper"] == (1, Decimal("100.00"), 3, Decimal("490.00"), -2, Decimal("-390.00"))
    assert summ["electronic"] == (1, Decimal("200.00"), 1, Decimal("220.00"), 0, Decimal("-20.00"))
    assert summ["total"] == (2, Decimal("300.00"), 4, Decimal("710.00"), -2, Decimal("-410.00"))
    pd_ = out["paper_detail"].collect()
    assert sorted(r.outcome for r in pd_) == ["only_a", "only_b", "only_b", "only_b"]
    assert [(r.num_key, r.amount_key) for r in pd_ if r.outcome == "only_a"] == [("F001", "100.00")]
    # invariants between sheets
    assert sum(r.delta for r in pd_) == summ["paper"][5]
    t = out["paper_detail_total"].first()
    assert (t.only_a_rows, t.only_b_rows, t.delta) == (1, 3, Decimal("-390.00"))
    ed_rows = out["electronic_detail"].collect()
    assert ed_rows[-1].outcome == "total" and abs(ed_rows[0].delta_sum) >= abs(ed_rows[1].delta_sum)
    ed = {r.outcome: r for r in ed_rows}
    assert (ed["total"].delta_rows, ed["total"].delta_sum) == (summ["electronic"][4], summ["electronic"][5])
    ov = out["overview"].first()
    assert ov.period == "Tutto il periodo" and ov.b_paper["count"] == 3 and ov.a_electronic["imponibile"] == Decimal("200.00")
    assert ov.b_paper["amount_column"] == "Importo pagato"
    drill = out["drilldown"].collect()
    assert {r.k for r in drill} == {"ID2", "123"}


def test_compare_header_variants_fx7(spark):
    reg = _with_order(strings(spark, REG6_HEADER, [REG6[1][:12] + ["123"]]))
    por = strings(spark, ["Identificativo SDI", "Numero fattura", "Data emissione", "Importo fattura", "Ragione Sociale"],
                  [["123", "n1", "2025-01-20", "200.0", "Ragione B"]])
    out = jobs.compare_ledgers(reg, _with_order(por))
    summ = {r.category: (r.b_n, r.delta_amt) for r in out["summary"].collect()}
    assert summ["electronic"] == (1, Decimal("0.00"))
    paid = jobs.portal_paid_report(strings(spark, ["Ragione Sociale", "Numero fattura", "Identificativo SDI",
                                                   "Data emissione", "Importo fattura"],
                                           [["R", "n", "", "2025-01-01", "10"]]))["stats"].first()
    assert (paid.paper_records, paid.electronic_records) == (1, 0)


def test_compare_period_guard(spark):
    reg = _with_order(strings(spark, REG6_HEADER, REG6))
    por = _with_order(strings(spark, POR6_HEADER, POR6))
    with pytest.raises(ValueError, match="quarters"):
        jobs.compare_ledgers(reg, por, "Registro I TRIM 2025.csv", "Portale II TRIM 2025.xlsx")
    out = jobs.compare_ledgers(reg, por, "Registro I TRIM 2025.csv", "Portale.xlsx")
    assert out["overview"].first().period == "01/01/2025 - 31/03/2025"


def test_write_report(spark, tmpdir_path):
    out = jobs.portal_paid_report(strings(spark, FX3_HEADER, FX3))
    paths = jobs.write_report(out, os.path.join(tmpdir_path, "report"))
    assert spark.read.parquet(paths["stats"]).count() == 1


def test_compare_materialized_report(spark, tmpdir_path):
    reg = _with_order(strings(spark, REG6_HEADER, REG6))
    por = _with_order(strings(spark, POR6_HEADER, POR6))
    out = jobs.compare_ledgers(reg, por, materialize=True)
    paths = jobs.write_report(out, os.path.join(tmpdir_path, "cmp"))
    assert set(paths) >= {"summary", "paper_detail", "electronic_detail", "delta", "drilldown", "overview"}
    assert spark.read.parquet(paths["summary"]).count() == 3


def test_a_report_is_published_whole(spark, tmpdir_path):
    """A table that fails, or tables that disagree, leave the earlier report; the manifest counts what was written."""
    reg, por = _with_order(strings(spark, REG6_HEADER, REG6)), _with_order(strings(spark, POR6_HEADER, POR6))
    place = os.path.join(tmpdir_path, "out")
    tables = jobs.compare_ledgers(reg, por, materialize=True)
    jobs.write_report(tables, place, check=jobs.comparison_invariants)
    first = {r["table"]: r for r in spark.read.json(f"{place}/manifest").collect()}
    assert first["summary"].rows == 3 and first["paper_detail"].rows == 4 and first["paper_detail"].totals.delta == "-390.00"
    before = sorted(os.listdir(place))
    broken = {"summary": spark.range(2), "paper_detail": spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception, match="lost"):
        jobs.write_report(broken, place)
    other = dict(tables) | {"paper_detail": tables["paper_detail"].limit(1)}
    with pytest.raises(ValueError, match="paper detail sums"):
        jobs.write_report(other, place, check=jobs.comparison_invariants)
    assert sorted(os.listdir(place)) == before and os.listdir(tmpdir_path) == ["out"]
    assert spark.read.parquet(f"{place}/summary").count() == 3
    with pytest.raises(ValueError, match="exists"):
        jobs.write_report(tables, place, mode="error")
    jobs.write_report({"summary": spark.range(7)}, place, fmt="csv")
    assert sorted(x for x in os.listdir(place) if not x.startswith(".")) == ["manifest", "summary"]


def test_cli_compare(spark, tmpdir_path):
    from tallyspark.__main__ import main
    reg = os.path.join(tmpdir_path, "reg.csv")
    with open(reg, "w") as fh:
        fh.write(";".join(REG6_HEADER) + "\n" + "\n".join(";".join(r) for r in REG6) + "\n")
    from tallyspark.sources import write_xlsx
    por = os.path.join(tmpdir_path, "por.xlsx")
    write_xlsx(por, POR6_HEADER, POR6)
    out = os.path.join(tmpdir_path, "out")
    main(["compare", reg, por, out])
    s = {r.category: r.delta_amt for r in spark.read.parquet(out + "/summary").collect()}
    assert s["total"] == Decimal("-410.00")


def test_compare_to_check_sheet(spark):
    out = jobs.compare_ledgers(_with_order(strings(spark, REG6_HEADER, REG6)), _with_order(strings(spark, POR6_HEADER, POR6)))
    rows = {r.category: r.detail_table for r in out["to_check"].collect()}
    assert rows == {"paper": "paper_detail", "electronic": "electronic_detail", "total": None}


def test_detail_reads_numbers_after_its_sort(spark):
    """The sort of the register's detail reads its input twice: numbers aren't read below it."""
    out = jobs.register_report(_with_order(strings(spark, FX1_HEADER, FX1)))["data"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[:plan.index("Sort [")], plan[plan.index("Sort ["):]
    assert "[eE]" in above and "[eE]" not in below
