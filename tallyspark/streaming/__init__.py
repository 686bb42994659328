"""Incremental landing of ledger exports (Structured Streaming).

The source application has no streaming semantics: quarterly exports are
uploaded as files and processed as a whole. The Spark-native equivalent of
"files keep arriving" is a file-source stream that lands every new export
as all-string rows (plus its file name) in a parquet table; the batch jobs
of :mod:`tallyspark.plans.jobs` then read that table. No windowed or
stateful operator is built, because the source has none.
"""

from tallyspark.streaming.landing import land_exports

__all__ = ["land_exports"]
