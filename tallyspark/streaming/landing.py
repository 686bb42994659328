"""File-source stream → parquet landing table (see package docstring)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyspark.sources.delimited import survey_files


def land_exports(spark: SparkSession, folder: str, sample_file: str, out_path: str,
                 checkpoint: str | None = None, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Stream every CSV export dropped in ``folder`` into ``out_path``.

    The header, delimiter and encoding come from ``sample_file`` (same
    layout as the stream). Rows are kept as strings with ``_src`` (file
    name) and ``_landed`` (ingestion time); the table is partitioned by
    ``_src`` so a job can read one export or a quarter of them. The stream's
    checkpoint lies beside the data, in ``_checkpoint`` under ``out_path`` (readers
    skip names that begin with an underscore), so that the next scheduled run
    finds it, unless ``checkpoint`` is given. ``available_now`` processes what is there and
    stops (a scheduled run); otherwise the query keeps running.
    """
    fact = next(iter(survey_files(spark, sample_file).values()))
    enc, sep, names = fact["encoding"], fact["delim"], fact["names"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = (spark.readStream.schema(schema).option("header", "true").option("sep", sep)
              .option("encoding", enc).option("mode", "PERMISSIVE"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.csv(folder).select(
        "*", F.col("_metadata.file_name").alias("_src"), F.current_timestamp().alias("_landed"))
    ckpt = checkpoint or f"{out_path.rstrip('/')}/_checkpoint"
    w = (stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
         .partitionBy("_src").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
