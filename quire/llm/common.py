"""Helpers shared by the corpus operators: materialised tables, arrow text buffers, and
vectorised tokenising of whole batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir

#: Rows of an arrow batch.  Texts can be long, so a Python worker must not hold the
#: 10,000 rows that Spark sends by default.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep arrow batches small enough for a worker's memory (only ever lowers the setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table under the shared checkpoint folder and read it back.

    Cuts the lineage and survives lost executors; the rows are computed once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame) -> DataFrame:
    """``df``, a table of ids, in fewer partitions: its tasks and files are short, so each takes up to
    eight shuffle partitions, but there stay two for a core."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from a key, the same on every run: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


# ---------------------------------------------------------------- texts in arrow batches
def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (or binary) column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts [a, b) of together at most ``limit`` bytes, or of one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


_CLASS = np.full(256, 2, np.uint8)                      # 2: punctuation and symbols
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1  # word bytes
_CLASS[[0x20, *range(0x09, 0x0E), 0x00]] = 0             # white space
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a run of texts: per token its 64-bit hash (ASCII letters lower-cased), its
    text's number, its first byte's place and its length in bytes.  A token is a run of word
    bytes (letters, digits, everything beyond ASCII) or a run of punctuation."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    cls = _CLASS[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(starts, append=n)
    place = np.arange(n) - np.repeat(starts, lengths)
    value = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * POWERS[place & 4095]
    hashes = np.add.reduceat(value, starts)
    real = cls[starts] > 0
    starts, lengths, hashes = starts[real], lengths[real], hashes[real]
    doc = np.searchsorted(offsets, starts, "right") - 1
    return mix(hashes + lengths.astype(np.uint64)), doc, starts, lengths
