"""Labelled rows for the classifiers: folds by a checksum, bounded samples, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def training_ids(labels: DataFrame, label_col: str, allowed: Column, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` labelled ids and their 0/1 labels, chosen by a hash of the id and
    sorted by id.  Rows without id or label don't count; of several labels of one id the
    more frequent holds (a tie: 1)."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
            .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & allowed)
            .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toPandas())
    rows = rows.sort_values("doc_id")
    return rows["doc_id"].to_numpy(np.int64), rows["y"].to_numpy(np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which held-back logits fit their labels best (log loss)."""
    if len(y) == 0:
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])
