"""Protocol codes of the register and their classes.

The code table is data: a 26-row dimension with a proven, fixed size, so it
is always safe to broadcast or to inline as an ``IN`` list (Catalyst turns a
long ``isin`` into a hash ``InSet``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.common import as_col, strip

PAPER, ELECTRONIC, SELF_INVOICE = "paper", "electronic", "self_invoice"

# Fixed values: (code, description) per class, in report order.
PAPER_CODES = (
    ("P", "Fatture Cartacee San"),
    ("2P", "Fatture Cartacee Ter"),
    ("L", "Fatture Lib.Prof. San"),
    ("FCBI", "Fatture Cartacee Estere San"),
    ("FCSI", "Fatture Cartacee Estere San"),
    ("FCBE", "Fatture Cartacee Estere San"),
    ("FCSE", "Fatture Cartacee Estere San"),
)
ELECTRONIC_CODES = (
    ("EP", "Fatture Elettroniche San"),
    ("2EP", "Fatture Elettroniche Ter"),
    ("EL", "Fatture Elettroniche Lib.Prof. San"),
    ("2EL", "Fatture Elettroniche Lib.Prof. Ter"),
    ("EZ", "Fatture Elettroniche Commerciali San"),
    ("2EZ", "Fatture Elettroniche Commerciali Ter"),
    ("EZP", "Fatture Elettroniche Commerciali San"),
    ("FPIC", "Fatture Elettroniche Estere San"),
    ("FSIC", "Fatture Elettroniche Estere San"),
    ("FPEC", "Fatture Elettroniche Estere San"),
    ("FSEC", "Fatture Elettroniche Estere San"),
)
SELF_INVOICE_CODES = (
    ("AFIC", "Autofatture Elettroniche San"),
    ("ASIC", "Autofatture Elettroniche San"),
    ("AFEC", "Autofatture Elettroniche San"),
    ("ASEC", "Autofatture Elettroniche San"),
    ("ACBI", "Autofatture Elettroniche San"),
    ("ACSI", "Autofatture Elettroniche San"),
    ("ACBE", "Autofatture Elettroniche San"),
    ("ACSE", "Autofatture Elettroniche San"),
)
# The alternative allowed list of the step-count scripts
# (adds LABI; no L, no self-invoices).
ALT_ALLOWED_CODES = ("P", "2P", "LABI", "FCBI", "FCSI", "FCBE", "FCSE", "EP", "2EP", "EL", "2EL",
                     "EZ", "2EZ", "EZP", "FPIC", "FSIC", "FPEC", "FSEC")

CLASS_CODES = {
    PAPER: tuple(c for c, _ in PAPER_CODES),
    ELECTRONIC: tuple(c for c, _ in ELECTRONIC_CODES),
    SELF_INVOICE: tuple(c for c, _ in SELF_INVOICE_CODES),
}
ALLOWED_CODES = CLASS_CODES[PAPER] + CLASS_CODES[ELECTRONIC] + CLASS_CODES[SELF_INVOICE]


def code_rows(classes: dict[str, Iterable] | None = None) -> list[tuple[int, str, str, str]]:
    """``(position, code, description, class)`` rows of the dimension."""
    table = classes or {PAPER: PAPER_CODES, ELECTRONIC: ELECTRONIC_CODES, SELF_INVOICE: SELF_INVOICE_CODES}
    rows, pos = [], 0
    for cls, codes in table.items():
        for item in codes:
            code, descr = (item, "") if isinstance(item, str) else item
            pos += 1
            rows.append((pos, code, descr, cls))
    return rows


def code_dimension(spark: SparkSession, classes: dict[str, Iterable] | None = None) -> DataFrame:
    """The code dimension as a small DataFrame (pos, code, descr, cls)."""
    return spark.createDataFrame(code_rows(classes), "pos int, code string, descr string, cls string")


def clean_code(c) -> Column:
    """Codes are compared stripped and upper-cased."""
    return F.upper(strip(F.coalesce(as_col(c).cast("string"), F.lit(""))))


def code_class(code, classes: dict[str, Iterable[str]] | None = None) -> Column:
    """class of a (cleaned) code; NULL when the code is not listed."""
    table = classes or CLASS_CODES
    k = clean_code(code)
    out = None
    for cls, codes in table.items():
        codes = [c if isinstance(c, str) else c[0] for c in codes]
        cond = k.isin(*codes)
        out = F.when(cond, F.lit(cls)) if out is None else out.when(cond, F.lit(cls))
    return out


def summary_class(code, classes: dict[str, Iterable[str]] | None = None) -> Column:
    """Class used by the summaries: self-invoices count as electronic."""
    c = code_class(code, classes)
    return F.when(c == SELF_INVOICE, F.lit(ELECTRONIC)).otherwise(c)


def is_allowed(code, allowed: Iterable[str] = ALLOWED_CODES) -> Column:
    """P1/P2 predicate on the cleaned code."""
    return clean_code(code).isin(*list(allowed))
