"""Page store: captured pages bucketed by id, so that joins on the id move no html.

``pages`` of a job are joined with ids again and again (which pages does this level reach, whose
items go into a book).  A store holds them hashed into a fixed number of buckets by ``page_id``;
a join on the id then deals out the ids only.  Writing it is the one time html is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_page_store(pages: DataFrame, table: str, buckets: int) -> DataFrame:
    """Write ``(page_id, url, html)`` as ``table`` of the session's catalog, replacing it.

    ``buckets`` fixes the number of tasks that later read the store (a bucket is read whole), so
    choose it by the store's size: some hundred MB of html a bucket.  Each bucket is one file."""
    (pages.select("page_id", "url", "html").repartition(buckets, "page_id")
     .write.mode("overwrite").format("parquet").bucketBy(buckets, "page_id").sortBy("page_id").saveAsTable(table))
    return read_page_store(pages.sparkSession, table)


def read_page_store(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
