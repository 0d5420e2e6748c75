"""Incremental ingestion: pages that arrive as files are parsed once (the `downloaded` and `parsed` flags of a crawl, as a stream's checkpoint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources import html


def stream_of(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder, each read once, `per_trigger` of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def parse_pages(pages: DataFrame, out: str, checkpoint: str, key: str = "page_id", source: str = "html") -> StreamingQuery:
    """Heads of new pages appended to a table, exactly once; a batch that is run again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        html.page_heads(batch, key, source).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def message_counts(messages: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Messages by window and kind; a window is final once the watermark has passed it."""
    return messages.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
