"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir

#: [\x20\x09-\x0D]: what separates words unless an operator says otherwise.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` long and ``text`` string, so that
    no other column of ``df``, whatever its name, can clash with what the operator adds."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def crc32_of_id(col: Column | str) -> Column:
    """crc32 of the decimal text of an id (null: of the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder in ``spark.checkpoint.dir`` and read it again: its lineage
    is cut, a lost executor costs nothing that was written, and the plan knows the table's size.
    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand memory that was freed back to the system. Python workers are kept for later stages, which would
    otherwise run beside what the largest earlier one once needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def blocks(batches: Iterable[pa.RecordBatch], max_bytes: int = 16 << 20, max_rows: int = 20_000) -> Iterator[pa.Table]:
    """The rows of a partition in tables of about ``max_bytes`` (a single row may be larger)."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            n = part.get_total_buffer_size() if part.num_rows == batch.num_rows else batch.nbytes * part.num_rows // batch.num_rows
            if held and (size + n > max_bytes or rows + part.num_rows > max_rows):
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
            held.append(part)
            size += n
            rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held)
