"""End-to-end jobs and their result surface (K1–K4).

Each job takes DataFrames of *string* columns as read by
:mod:`tallyspark.sources` (plus a ``_row`` file-order column) and returns a
dict of named result DataFrames — lazily built, nothing collected. The only
driver work is header mapping and, where the source requires it, a
one-row "is anything left" probe.

The jobs work on the neutral canonical names:
``party, doc_date, doc_no, reg_date, code, sign, seq_no, amount, tax,
tax_code, withholding, order_no, order_total, ext_id, value_date``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyspark.functions import (
    ALLOWED_CODES, CLASS_CODES, ELECTRONIC, PAPER, SELF_INVOICE, amount_key, clean_code, code_class,
    code_dimension, is_empty_id, net_amount, normalize_id, parse_date, parse_number_comma,
    parse_number_mixed, parse_number_plain, quarter_from_name, signed_amount, text_key, to_money,
)
from tallyspark.functions.common import as_col, strip
from tallyspark.functions.numbers import SUM_TYPE, out_of_range
from tallyspark.operators import aggregates as agg
from tallyspark.operators import filters as flt
from tallyspark.operators import reconcile as rec
from tallyspark.operators.dedup import dedup_first, dedup_first_counted
from tallyspark.session import checkpoint_dir
from tallyspark.plans.layout import (
    COMPARE_PORTAL, COMPARE_REGISTER, PORTAL_OPTIONAL, PORTAL_PAID, PORTAL_REQUIRED,
    RECEIVED_COLUMNS, REGISTER, MissingColumnsError, apply_layout,
)

ROW = "_row"
# How the comparison summary names the amount of each side.
REGISTER_AMOUNT_LABEL = "IMPONIBILE (con segno) - RIT(EL/2EL/L)"
PORTAL_AMOUNT_LABEL = "Importo pagato"


class LazyTables(Mapping):
    """Result tables built on first access (and then kept).

    Building some tables runs a small job (e.g. the hot-key probe of the
    multiset difference); a caller that reads one table pays for that table
    only. ``write_report`` and iteration build them all.
    """

    def __init__(self, factories: dict):
        self._factories = dict(factories)
        self._built: dict = {}

    def __getitem__(self, name):
        if name not in self._built:
            self._built[name] = self._factories[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._factories)

    def __len__(self):
        return len(self._factories)


# Fixed value: the label of a comparison without a period.
ALL_PERIOD_LABEL = "Tutto il periodo"


SRC, EXTRA = "_src", "_extra"


def _file_order(df: DataFrame) -> list:
    """File order: (file name, position in the file). Within one file
    ``_row`` increases with the position; across files Spark packs splits by
    size, so the file name comes first."""
    return [F.col(c) for c in _order_cols(df)]


def _order_cols(df: DataFrame) -> list[str]:
    return [c for c in (SRC, ROW) if c in df.columns]


def _materialize(df: DataFrame, on: bool) -> DataFrame:
    """Reliable checkpoint in the cluster's shared checkpoint folder (never a
    local checkpoint): several result tables then read the cleaned ledger
    instead of recomputing it, and a lost executor costs no recomputation
    of the dedup shuffle."""
    if not on:
        return df
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _require_order(df: DataFrame, order=None) -> DataFrame:
    """Keep-first needs an order: the file order that the readers of
    :mod:`tallyspark.sources` supply, or one that the caller states. None is made
    up here, because a row number taken in the middle of a plan may differ each
    time the plan runs."""
    if order is None and ROW not in df.columns:
        raise ValueError(f"no file order: read with tallyspark.sources (column {ROW!r}) or give order=")
    return df


# ------------------------------------------------------------------- E1
def register_report(raw: DataFrame, check_nonempty: bool = True, order=None,
                    materialize: bool = False) -> dict[str, DataFrame]:
    """Clean one register export.

    Layout → keep-first on (doc date, doc no, id) in file order **before**
    the code filter (D1), which counts the duplicates too (D3) → allowed codes (P1) →
    month-first dates, mixed-locale amounts (failures → 0), sign, net of
    withholding → detail sorted by registration date (W2), per-class code
    summaries with zero rows (A2) and the stats row (K3). ``order`` replaces
    the file order (``_row``) as the meaning of "first".

    Every table comes from one scan and one shuffle of its own columns (with ``materialize`` all from one
    checkpoint). Malformed rows (read with ``keep_bad``:
    ``_extra`` is set) are counted as ``skipped_rows`` of the stats and belong to nothing else.
    """
    df = _require_order(apply_layout(raw, REGISTER), order)
    df = df.withColumn("FAT_PROT", clean_code("FAT_PROT"))
    key = ["FAT_DATDOC", "FAT_NDOC", "TMC_G8"]
    if EXTRA in df.columns:  # each malformed row is a group of its own
        df = df.withColumn("_bad", F.when(F.col(EXTRA).isNotNull(), F.monotonically_increasing_id())).drop(EXTRA)
        key = [*key, "_bad"]
    else:
        df = df.withColumn("_bad", F.lit(None).cast("bigint"))
    place = _order_cols(df)
    if order is not None:
        place = [f"_place{i}" for i in range(len(order))]
        df = df.withColumns({name: as_col(c) for name, c in zip(place, order, strict=True)})
    # the sort of the detail reads its input twice: its date is read before the dedup, numbers after the sort
    df = df.withColumn("reg_date", parse_date("FAT_DATREG", day_first=False)).withColumn(
        "_allowed", F.col("_bad").isNull() & F.coalesce(F.col("FAT_PROT").isin(*ALLOWED_CODES), F.lit(False)))
    numbers = ["IMPONIBILE", "FAT_TOTIVA", "TMA_TOT", "RA_IMPOSTA"]
    texts = ["C_NOME", "FT_SEGNO", "FAT_PROT", "FAT_NUM", "RA_CODTRIB", "DMA_NUM", "M2_TMC_DATREG"]
    order_cols = _order_cols(df)
    df = df.select(*dict.fromkeys([*order_cols, *place, "FAT_DATDOC", "FAT_NDOC", "TMC_G8", "_bad", "reg_date", *texts, *numbers, "_allowed"]))

    def shown(firsts):
        d = firsts.select(
            *order_cols,
            F.col("C_NOME").alias("party"),
            parse_date("FAT_DATDOC", day_first=False).alias("doc_date"),
            F.col("FAT_NDOC").alias("doc_no"),
            "reg_date",
            F.col("FAT_PROT").alias("code"),
            F.col("FT_SEGNO").alias("sign"),
            F.col("FAT_NUM").alias("seq_no"),
            parse_number_mixed("IMPONIBILE", default=0).alias("_amount"),
            parse_number_mixed("FAT_TOTIVA", default=0).alias("_tax"),
            F.upper(strip(F.coalesce(F.col("RA_CODTRIB").cast("string"), F.lit("")))).alias("tax_code"),
            F.col("DMA_NUM").alias("order_no"),
            parse_number_mixed("TMA_TOT", default=0).alias("_order_total"),
            parse_number_mixed("RA_IMPOSTA", default=0).alias("_withholding"),
            F.col("TMC_G8").alias("ext_id"),
            F.col("M2_TMC_DATREG").alias("value_date"),
        )
        return d.select(
            "*",
            net_amount("_amount", "sign", "code", "_withholding").alias("amount"),
            signed_amount("_tax", "sign").alias("tax"),
            signed_amount("_order_total", "sign").alias("order_total"),
            signed_amount("_withholding", "sign").alias("withholding"),
        ).drop("_amount", "_tax", "_order_total", "_withholding") \
         .withColumn("paid", F.col("amount")) \
         .withColumn("cls", code_class("code"))

    # the count of copies needs every row of a key, the other tables only its first
    facts = ["_allowed", "FAT_PROT", "FT_SEGNO", "IMPONIBILE", "RA_IMPOSTA", "_bad"]
    if materialize:
        every = counted = _materialize(dedup_first_counted(df, key, place), True)
    else:
        every = dedup_first(df, key, place)
        counted = dedup_first_counted(df.select(*dict.fromkeys([*key, *place, *facts])), key, place)
    every = every.where("_allowed")
    d = shown(every)
    # With ``materialize`` the probe reads the checkpoint; otherwise it costs
    # one run of the dedup shuffle before the result tables are built.
    if check_nonempty and d.isEmpty():
        raise ValueError("no row of the register has an allowed protocol code")
    data = shown(every.orderBy(F.col("reg_date").asc_nulls_last(), *_file_order(every)))
    summary = agg.code_summary(d, code_dimension(raw.sparkSession), "code", "paid",
                               total_label="TOTALE", by="cls")
    sheets = {f"summary_{c}": summary.where(F.col("cls") == c).drop("cls")
              for c in (PAPER, ELECTRONIC, SELF_INVOICE)}
    amount = net_amount("_amount", "FT_SEGNO", "FAT_PROT", "_withholding")
    stats = _register_stats(counted.select(
        "*", parse_number_mixed("IMPONIBILE", default=0).alias("_amount"), parse_number_mixed("RA_IMPOSTA", default=0).alias("_withholding")).select(
        "_allowed", (out_of_range("IMPONIBILE") | out_of_range("RA_IMPOSTA")).alias("_rejected"), amount.alias("paid"),
        code_class("FAT_PROT").alias("cls"), F.col("_bad").isNotNull().alias("_bad"), "_copies"))
    if EXTRA not in raw.columns:
        stats = stats.drop("skipped_rows")
    # A5: the totals row of the detail sheet (plain sums of the money columns)
    data_total = d.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(SUM_TYPE).alias(c)
                         for c in ("amount", "paid", "tax", "order_total", "withholding")])
    return {"data": data, "data_total": data_total, "summary": summary, **sheets, "stats": stats,
            "code_counts": agg.count_codes(d, "code", ALLOWED_CODES)}


def _register_stats(every: DataFrame) -> DataFrame:
    ok = F.col("_allowed")
    paper = ok & (F.col("cls") == PAPER)
    elec = ok & F.col("cls").isin(ELECTRONIC, SELF_INVOICE)
    return every.agg(
        F.count_if(ok).cast("bigint").alias("total_records"),
        F.sum(F.when(paper, 1).otherwise(0)).cast("bigint").alias("paper_records"),
        F.sum(F.when(elec, 1).otherwise(0)).cast("bigint").alias("electronic_records"),
        F.coalesce(F.sum(F.when(paper, F.col("paid"))), F.lit(0)).cast(SUM_TYPE).alias("paper_amount"),
        F.coalesce(F.sum(F.when(elec, F.col("paid"))), F.lit(0)).cast(SUM_TYPE).alias("electronic_amount"),
        F.count_if(ok & F.col("_rejected")).cast("bigint").alias("rejected_amounts"),
        F.coalesce(F.sum(F.when(~F.col("_bad"), F.col("_copies") - 1)), F.lit(0)).cast("bigint").alias("duplicates_removed"),
        F.count_if("_bad").cast("bigint").alias("skipped_rows"),
    )


# ------------------------------------------------------------------- E2
def portal_paid_report(raw: DataFrame, max_rows: int | None = None) -> dict[str, DataFrame]:
    """Portal export of paid invoices.

    Layout (aliases, letter columns) → empty-id split (tokens rule N2) →
    detail with a plain-coerced total row (A5; the first ``max_rows`` rows in
    file order when given, P9) → class totals (A4) with mixed-locale amounts; the amount is
    ``Importo pagato`` when that column exists, else ``Importo fattura``.
    """
    df = apply_layout(raw, PORTAL_PAID)
    if max_rows is not None:
        _require_order(df)
    optional = [c for c in PORTAL_OPTIONAL if c in df.columns]
    df = df.select(*PORTAL_REQUIRED, *optional, *_order_cols(df))
    amount_col = "Importo pagato" if "Importo pagato" in df.columns else "Importo fattura"
    flagged = flt.with_empty_flag(df, "Identificativo SDI", "tokens", "is_paper")
    shown = df if max_rows is None else flt.cap_rows(df, max_rows, _file_order(df))
    money_cols = [c for c in ("Importo pagato", "Importo fattura", "Importo liquidato") if c in df.columns]
    shown_num = shown.select(*[to_money(parse_number_plain(c)).alias(c) if c in money_cols
                               else F.col(f"`{c}`") for c in shown.columns])
    data = agg.detail_with_totals(shown_num.drop(ROW, SRC), money_cols, "Creditore")
    stats = _split_stats(flagged, to_money(parse_number_mixed(amount_col, default=0)), out_of_range(amount_col))
    return {"data": data, "stats": stats}


def _split_stats(flagged: DataFrame, amount, rejected) -> DataFrame:
    paper = F.col("is_paper")
    return flagged.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_records"),
        F.sum(F.when(paper, 1).otherwise(0)).cast("bigint").alias("paper_records"),
        F.sum(F.when(~paper, 1).otherwise(0)).cast("bigint").alias("electronic_records"),
        F.coalesce(F.sum(F.when(paper, amount)), F.lit(0)).cast(SUM_TYPE).alias("paper_amount"),
        F.coalesce(F.sum(F.when(~paper, amount)), F.lit(0)).cast(SUM_TYPE).alias("electronic_amount"),
        F.lit(0).cast("bigint").alias("duplicates_removed"),
        F.count_if(rejected).cast("bigint").alias("rejected_amounts"),
    )


# ------------------------------------------------------------------- E3
def portal_received_report(raw: DataFrame, file_name: str | None = None, max_rows: int | None = None) -> dict[str, DataFrame]:
    """Portal export of received invoices.

    The eight columns are selected by exact name (S6, error lists the
    missing ones) → comma-decimal amounts (F3, unparseable → 0) → taxable = total − VAT
    (F16) → month-first dates → period of the file name's quarter on the
    payment date (P3) → empty-id split (N2) → totals of ``Totale fatture``.
    """
    missing = [c for c in RECEIVED_COLUMNS if c not in raw.columns]
    if missing:
        raise MissingColumnsError("Colonne mancanti", missing)
    df = raw if max_rows is None else _require_order(raw)
    total = parse_number_comma("Importo fattura", default=0)
    vat = parse_number_comma("IVA", default=0)
    out = df.select(
        *_order_cols(df),
        F.col("Creditore").alias("Ragione sociale"),
        F.col("Numero fattura").alias("N.fatture"),
        parse_date("Data emissione", day_first=False).alias("Data emissione"),
        parse_date("Data documento", day_first=False).alias("Data documento"),
        parse_date("Data pagamento", day_first=False).alias("Data pagamento"),
        vat.alias("Ivam"),
        (total - vat).alias("Imponibile"),
        total.alias("Totale fatture"),
        F.col("Identificativo SDI"),
        (out_of_range("Importo fattura", "comma") | out_of_range("IVA", "comma")).alias("_rejected"),
    )
    period = quarter_from_name(os.path.basename(file_name)) if file_name else None
    out = flt.filter_period(out, "Data pagamento", period)
    flagged = flt.with_empty_flag(out, "Identificativo SDI", "tokens", "is_paper")
    shown = (out if max_rows is None else flt.cap_rows(out, max_rows, _file_order(out))).drop(ROW, SRC, "_rejected")
    data = agg.detail_with_totals(shown, ["Ivam", "Imponibile", "Totale fatture"], "Ragione sociale")
    stats = _split_stats(flagged, F.col("Totale fatture"), F.col("_rejected"))
    return {"data": data, "stats": stats}


# ------------------------------------------------------------------- E4
def load_compare_register(raw: DataFrame) -> DataFrame:
    """Register side of the comparison before any filter (also the input of
    the arrival lookup J8/J12)."""
    return apply_layout(raw, COMPARE_REGISTER)


def load_compare_portal(raw: DataFrame) -> DataFrame:
    df = apply_layout(raw, COMPARE_PORTAL)
    return df.select(*PORTAL_REQUIRED, *_order_cols(df))


def compare_ledgers(register_raw: DataFrame, portal_raw: DataFrame, register_name: str | None = None,
                    portal_name: str | None = None, top_n: int = 30, per_side: int = 20,
                    order=None, materialize: bool = False) -> Mapping[str, DataFrame]:
    """Reconcile a register export with a portal export.

    Register: allowed codes (P1) **then** keep-first on (doc date, doc no,
    id) (D2), day-first dates, mixed-locale amounts (failures → 0), sign and
    net of withholding, normalised ids; class by code. Portal: class by
    empty id (strict rule N1). Results: ``summary`` (J1, also the second
    overview sheet), ``paper_detail`` (J4 on text number + 2-decimal
    amount), ``electronic_detail`` (J2 with the empty-id row and total),
    ``delta`` (J3), ``drilldown`` (J5), ``overview`` (K4). With
    ``materialize`` both cleaned ledgers are checkpointed once (use it when
    writing several of the tables).
    """
    reg_period = quarter_from_name(os.path.basename(register_name)) if register_name else None
    por_period = quarter_from_name(os.path.basename(portal_name)) if portal_name else None
    if reg_period and por_period and reg_period != por_period:
        raise ValueError("the file names give different quarters")
    reg = _require_order(load_compare_register(register_raw), order)
    por = load_compare_portal(portal_raw)

    a = reg.withColumn("FAT_PROT", clean_code("FAT_PROT")).where(F.col("FAT_PROT").isin(*ALLOWED_CODES))
    a = dedup_first(a, ["FAT_DATDOC", "FAT_NDOC", "TMC_G8"], order or _file_order(a))
    a = a.select(
        *_order_cols(a), F.col("C_NOME").alias("party"), F.col("FAT_PROT").alias("code"),
        F.col("FT_SEGNO").alias("sign"), F.col("FAT_NUM").alias("seq_no"), F.col("FAT_NDOC").alias("doc_no"),
        parse_date("FAT_DATDOC").alias("doc_date"), parse_date("FAT_DATREG").alias("reg_date"),
        F.col("M2_TMC_DATREG").alias("value_date"),
        parse_number_mixed("IMPONIBILE", default=0).alias("_amount"),
        parse_number_mixed("RA_IMPOSTA", default=0).alias("_withholding"),
        F.col("RA_CODTRIB").alias("tax_code"), normalize_id("TMC_G8").alias("ext_id"),
    )
    a = a.withColumn("amount", net_amount("_amount", "sign", "code", "_withholding")) \
         .drop("_amount", "_withholding") \
         .withColumn("cls", F.when(F.col("code").isin(*CLASS_CODES[PAPER]), F.lit(PAPER))
                     .when(F.col("code").isin(*(CLASS_CODES[ELECTRONIC] + CLASS_CODES[SELF_INVOICE])),
                           F.lit(ELECTRONIC)))
    b = por.select(
        *_order_cols(por), F.col("Creditore").alias("party"), F.col("Numero fattura").alias("doc_no"),
        parse_date("Data emissione").alias("doc_date"),
        to_money(parse_number_mixed("Importo fattura", default=0)).alias("amount"),
        normalize_id("Identificativo SDI").alias("ext_id"),
    ).withColumn("cls", F.when(is_empty_id("ext_id", "strict"), F.lit(PAPER)).otherwise(F.lit(ELECTRONIC)))
    a, b = _materialize(a, materialize), _materialize(b, materialize)

    period = reg_period or por_period
    label = (f"{period[0]:%d/%m/%Y} - {period[1]:%d/%m/%Y}" if period else ALL_PERIOD_LABEL)
    ae = a.where(F.col("cls") == ELECTRONIC)
    be = b.where(F.col("cls") == ELECTRONIC)
    ae_ok = ae.where(~is_empty_id("ext_id", "strict"))

    def summary():
        return rec.compare_summary(a, b, "cls", "cls", "amount", "amount")

    def paper_detail():
        ap = a.where(F.col("cls") == PAPER).withColumn("num_key", text_key("doc_no")) \
              .withColumn("amount_key", amount_key("amount"))
        bp = b.where(F.col("cls") == PAPER).withColumn("num_key", text_key("doc_no")) \
              .withColumn("amount_key", amount_key("amount"))
        return rec.multiset_diff(ap, bp, ["num_key", "amount_key"], ["doc_date", "doc_no", *_order_cols(ap)],
                                 ["doc_date", "doc_no", *_order_cols(bp)], "amount", "amount")

    def electronic_detail():
        # By |delta| descending (key as tie-break), the total row last
        out = rec.reconcile_sums(ae, be, "ext_id", "ext_id", "amount", "amount",
                                 empty_id_rule="strict", with_total=True)
        return out.orderBy((F.col("outcome") == "total").asc(), F.abs("delta_sum").desc(), F.col("k").asc_nulls_last())

    def delta():
        out = rec.reconcile_amounts(ae_ok, be, "ext_id", "ext_id", "amount", "amount", empty_id_rule=None)
        return out.orderBy(F.abs("delta_sum").desc(), F.col("k").asc_nulls_last())

    def drilldown():
        return rec.top_delta_detail(
            ae_ok.withColumn("k", F.col("ext_id")).withColumn("date", F.col("reg_date")),
            be.withColumn("k", F.col("ext_id")).withColumn("date", F.col("doc_date")),
            "k", "amount", "amount", a_order=["date", "doc_no", *_order_cols(ae_ok)],
            b_order=["date", "doc_no", *_order_cols(be)],
            top_n=top_n, per_side=per_side, cols=["party", "doc_no", "date"])

    def overview():
        s = tables["summary"]
        return s.where(F.col("category") != "total").groupBy().agg(
            F.lit(label).alias("period"),
            *[F.max(F.when(F.col("category") == c, F.struct(
                F.col("a_n").alias("count"), F.col("a_amt").alias("amount"),
                F.lit(REGISTER_AMOUNT_LABEL).alias("amount_column"), F.col("a_amt").alias("imponibile"))))
              .alias(f"a_{c}") for c in (PAPER, ELECTRONIC)],
            *[F.max(F.when(F.col("category") == c, F.struct(
                F.col("b_n").alias("count"), F.col("b_amt").alias("amount"),
                F.lit(PORTAL_AMOUNT_LABEL).alias("amount_column"), F.col("b_amt").alias("imponibile"))))
              .alias(f"b_{c}") for c in (PAPER, ELECTRONIC)],
        )

    def to_check():
        # the overview sheet: the summary plus the name of each class's detail table
        return tables["summary"].withColumn(
            "detail_table", F.when(F.col("category") == PAPER, F.lit("paper_detail"))
            .when(F.col("category") == ELECTRONIC, F.lit("electronic_detail")))

    def paper_detail_total():
        # the closing row of the paper sheet: rows per side and the total delta
        return tables["paper_detail"].agg(
            F.sum(F.when(F.col("outcome") == rec.ONLY_A, 1).otherwise(0)).cast("bigint").alias("only_a_rows"),
            F.sum(F.when(F.col("outcome") == rec.ONLY_B, 1).otherwise(0)).cast("bigint").alias("only_b_rows"),
            F.coalesce(F.sum("delta"), F.lit(0)).cast(SUM_TYPE).alias("delta"))

    tables = LazyTables({"summary": summary, "to_check": to_check, "paper_detail_total": paper_detail_total,
                         "paper_detail": paper_detail, "electronic_detail": electronic_detail,
                         "delta": delta, "drilldown": drilldown, "overview": overview})
    return tables


# ------------------------------------------------------------------- K1/K2
MANIFEST = "manifest"


def comparison_invariants(tables: Mapping[str, DataFrame]) -> list[str]:
    """What the tables of one comparison must agree on; a line for each disagreement."""
    def one(df, *cols):
        row = df.agg(*cols).first()
        return tuple(row)

    def money(cond=None, col="delta"):
        return F.coalesce(F.sum(F.col(col) if cond is None else F.when(cond, F.col(col))), F.lit(0)).cast(SUM_TYPE)

    of = lambda c, col: money(F.col("category") == c, col)
    paper, electronic, rows, total, total_rows, a_total = one(
        tables["summary"], of(PAPER, "delta_amt"), of(ELECTRONIC, "delta_amt"), of(ELECTRONIC, "delta_n"), of("total", "delta_amt"),
        of("total", "delta_n"), of(PAPER, "delta_n"))
    listed, = one(tables["paper_detail"], money())
    residue = F.col("outcome") == "total"
    listed_el, rows_el = one(tables["electronic_detail"].where(~residue), money(None, "delta_sum"), money(None, "delta_rows"))
    total_el, total_rows_el = one(tables["electronic_detail"].where(residue), money(None, "delta_sum"), money(None, "delta_rows"))
    found = []
    if listed != paper:
        found.append(f"paper detail sums to {listed}, the summary has {paper}")
    if (listed_el, rows_el) != (total_el, total_rows_el):
        found.append(f"electronic detail sums to {listed_el} over {rows_el} rows, its total row has {total_el} over {total_rows_el}")
    if rows != total_rows_el:  # amounts within the tolerance aren't listed, but rows are all
        found.append(f"electronic detail differs by {total_rows_el} rows, the summary by {rows}")
    if total != paper + electronic or total_rows != a_total + rows:
        found.append("the total of the summary isn't the sum of its classes")
    return found


def write_report(result: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet", mode: str = "overwrite",
                 check: Callable[[Mapping[str, DataFrame]], list[str]] | None = None) -> dict[str, str]:
    """K1/K2: one folder per result table (parquet or csv with header) and a table ``manifest`` of
    their rows and the totals of their money columns, counted while they are written.

    All tables are written to a folder beside ``out_dir``, ``check`` (e.g.
    :func:`comparison_invariants`) looks at what was written, and only then the folder takes the place of
    ``out_dir`` by a rename; whatever fails before leaves an earlier report as it was. ``mode``
    "error" refuses to replace one. Each table is written by the executors; nothing passes the driver."""
    if mode not in ("overwrite", "error"):
        raise ValueError(f"mode: overwrite or error, not {mode!r}")
    spark = next(iter(result.values())).sparkSession
    jvm, out_dir = spark.sparkContext._jvm, out_dir.rstrip("/")
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "error" and fs.exists(path(out_dir)):
        raise ValueError(f"{out_dir} exists")
    mark = uuid.uuid4().hex
    parent, name = os.path.split(out_dir)
    staged = f"{parent}/_{name}.{mark}" if parent else f"_{name}.{mark}"
    try:
        facts = []
        for table, df in result.items():
            seen = Observation(f"{table}.{mark}")
            sums = [c for c, kind in df.dtypes if kind.startswith("decimal")]
            counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f"`{c}`")).cast("string").alias(f"t{i}") for i, c in enumerate(sums)])
            _written(counted, f"{staged}/{table}", fmt)
            got = seen.get
            facts.append((table, got["rows"], {c: got[f"t{i}"] for i, c in enumerate(sums)}))
        _manifest = spark.createDataFrame(facts, "table string, rows long, totals map<string, string>")
        _manifest.coalesce(1).write.json(f"{staged}/{MANIFEST}")
        if check is not None:
            wrong = check({t: _read_back(spark, df, f"{staged}/{t}", fmt) for t, df in result.items()})
            if wrong:
                raise ValueError("the tables of the report disagree: " + "; ".join(wrong))
        old = None
        if fs.exists(path(out_dir)):
            old = path(f"{parent}/_{name}.old.{mark}" if parent else f"_{name}.old.{mark}")
            if not fs.rename(path(out_dir), old):
                raise OSError(f"cannot replace {out_dir}")
        elif parent:
            fs.mkdirs(path(parent))
        if not fs.rename(path(staged), path(out_dir)):
            if old is not None:
                fs.rename(old, path(out_dir))
            raise OSError(f"cannot publish {out_dir}")
        if old is not None:
            fs.delete(old, True)
    finally:
        if fs.exists(path(staged)):
            fs.delete(path(staged), True)
    return {table: f"{out_dir}/{table}" for table in result}


def _written(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        df.write.option("header", True).csv(path)
    else:
        df.write.parquet(path)


def _read_back(spark, df: DataFrame, path: str, fmt: str) -> DataFrame:
    reader = spark.read.schema(df.schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
