"""Captured image files as a source — bytes once per content, URLs beside them.

``files`` says which file holds the bytes of which URL (a capture run writes it).  Many URLs
show the same picture, so bytes are kept under their SHA-256 and URLs refer to it; joins of lines
with images then move hashes, and bytes only where a document is written.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import written


class Images(NamedTuple):
    """``contents``: (sha256, content, bytes), one row per picture; ``urls``: (url, sha256, bytes);
    ``failed``: (url, reason) of URLs without usable bytes."""
    contents: DataFrame
    urls: DataFrame
    failed: DataFrame


def read_images(spark: SparkSession, folder: str, files: DataFrame) -> Images:
    """The images of ``files`` (url, file), with ``file`` the path below ``folder``.

    A file that isn't there or is empty fails its URL, which is listed and not an error; of several
    files for one URL the least name counts; null URLs are left out."""
    root = folder.rstrip("/") + "/"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
           .select(F.substring_index("path", root, -1).alias("file"), F.col("length").alias("bytes"), "content"))
    hashed = raw.select("file", F.sha2("content", 256).alias("sha256"), "bytes", "content").filter("bytes > 0")
    contents = written(hashed.groupBy("sha256").agg(F.first("content").alias("content"), F.first("bytes").alias("bytes")))
    # names and hashes only: the bytes are not joined
    wanted = files.filter("url is not null").groupBy("url").agg(F.min("file").alias("file"))
    found = written(wanted.join(hashed.select("file", "sha256", "bytes"), "file", "left"))
    return Images(contents, found.filter("sha256 is not null").select("url", "sha256", "bytes"),
                  found.filter("sha256 is null").select("url", F.when(F.col("file").isNull(), "no_file").otherwise("missing_or_empty").alias("reason")))


def image_bytes(urls: DataFrame, images: Images) -> DataFrame:
    """``(url, content)`` of some URLs, for ``image_lookup`` and ``paragraphs``."""
    return urls.select("url").distinct().join(images.urls, "url").join(images.contents.select("sha256", "content"), "sha256").select("url", "content")
