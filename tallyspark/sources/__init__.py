"""Ledger sources: delimited text, spreadsheets, parquet.

Every reader returns all-string columns plus ``_row`` (file order) and
``_src`` (file name), which the jobs use for keep-first semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.delimited import (
    NA_TOKENS, bad_row_count, find_header_row, head_lines, raw_line_count, read_delimited,
    read_exports, read_flexible, select_columns, sniff_delimiter, survey_files,
)
from tallyspark.sources.xlsx import read_xlsx, write_xlsx


def read_parquet_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with its own row order (``_metadata.row_index``) and all
    columns as strings."""
    df = spark.read.parquet(path)
    cols = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    return df.select(*cols,
                     (F.col("_metadata.row_index")).alias("_row"),
                     F.col("_metadata.file_name").alias("_src"))


def read_ledger(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    """Pick the reader by ``fmt`` or by the file extension."""
    kind = (fmt or path.rsplit(".", 1)[-1]).lower()
    if kind in ("csv", "txt", "tsv"):
        return read_delimited(spark, path, **kw)
    if kind in ("xlsx", "xlsm", "excel"):
        return read_xlsx(spark, path, **kw)
    if kind == "parquet":
        return read_parquet_ledger(spark, path)
    raise ValueError(f"unsupported ledger format: {kind}")


__all__ = ["read_ledger", "read_delimited", "read_exports", "read_flexible", "read_xlsx", "read_parquet_ledger",
           "write_xlsx", "find_header_row", "select_columns", "raw_line_count",
           "bad_row_count", "head_lines", "sniff_delimiter", "survey_files", "NA_TOKENS"]
