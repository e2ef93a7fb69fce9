"""Structured streams: JSON lines as they come, appends that survive a restart, counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import append_missing


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """The folder's JSON lines as a stream: new files are read as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def append_stream(rows: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to JSON lines, of each key the first batch's; a batch that is run again appends nothing new.

    Ends when all that is there has been read; started again with the same checkpoint, it goes on.
    """
    writer = rows.writeStream.foreachBatch(lambda batch, _: append_missing(batch.dropDuplicates([key]), path, key))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_time(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per ``by`` and window of event time; rows later than ``late`` behind the latest seen are dropped by the
    watermark, so that a window's state can go. Works on streams and tables alike."""
    w = F.window(time, width)
    out = events.withWatermark(time, late).groupBy(w.alias("window"), by).agg(F.count("*").alias("n"))
    return out.select("window.start", "window.end", by, "n")
