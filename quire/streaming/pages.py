"""Incremental runs: newly captured page files go through the batch functions.

The reference has no streaming; this only lets a capture process drop page files into a
folder and have them sliced as they arrive.  Each micro-batch is a plain DataFrame, so
the page-level windows of the batch pipeline apply unchanged (row-number windows are not
allowed on a streaming DataFrame itself).  Output of micro-batch N is written to
``<sink>/batch_id=N`` with overwrite, so a batch replayed after a failure replaces its
own output instead of appending twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.html import page_items
from quire.operators.slices import extract_content

PAGES_SCHEMA = "page_id bigint, url string, html string"


def stream_page_content(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                        start_markers: list[str], stop_markers: list[str], remove: list[str],
                        include_images: bool = False, available_now: bool = True) -> StreamingQuery:
    """Start a query that writes the sliced content items of every new page file."""
    pages = spark.readStream.schema(PAGES_SCHEMA).parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        items = page_items(batch, include_images=include_images)
        content = extract_content(items, batch.select("page_id", "url"), start_markers,
                                  stop_markers, remove)
        (content.drop("runs").write.mode("overwrite")
         .parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}"))

    writer = (pages.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
