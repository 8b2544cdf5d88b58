"""Quality classifier: random-indexing word vectors, pooled, then a small calibrated network.

1. Random indexing.  Every term has a fixed sparse index vector of a few +1 and -1, drawn from
   the term's hash.  A term's context vector is the sum of the index vectors of its neighbours
   over the whole corpus.  Terms share ``BUCKETS`` rows by hash, so each task adds up one matrix
   of bounded size and the matrices are summed by row; what is gathered follows the input, what
   is broadcast is bounded by ``BUCKETS`` x ``DIMS``.
2. Pooling.  A document is the mean and spread of its terms' normalised context vectors, and the
   mean likeness of adjacent terms.
3. A two-layer numpy network is fitted on at most ``SAMPLE`` labelled documents; a held-back fifth
   of them sets the temperature of its probabilities.

Terms are runs of letters and digits (case folded for ASCII, with a mark for words in capitals)
and runs of punctuation.  Defined cases: null text counts as empty and is scored from an all-zero
vector; repeated rows get equal scores; an empty table gives no rows; without labels of both
kinds every score is the labels' mean (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, materialize, mix, small_batches, text_buffer, token_hashes
from quire.llm.labels import sigmoid, temperature, training_ids

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS = 24, 40
FEATURES = 2 * DIMS + 3

_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the places and signs of its index vector's entries."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(1, buckets * nonzero + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(buckets, nonzero)
    return (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def terms(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of each term; words of two or more capitals only hash apart."""
    hashes, doc, starts, lengths = token_hashes(data, offsets)
    if len(hashes) == 0:
        return np.zeros(0, np.int64), doc
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals = (lengths > 1) & (ups[starts + lengths] - ups[starts] == lengths)
    hashes = hashes + np.where(capitals, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    return (hashes % np.uint64(buckets)).astype(np.int64), doc


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Context vectors over the whole corpus: a row per bucket met, ``v0`` .. as longs."""
    small_batches(docs.sparkSession)
    columns = [f"v{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total, uses = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in chunks(offsets):
                t, doc = terms(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                uses += np.bincount(t, minlength=BUCKETS)
                for gap in range(1, REACH + 1):
                    same = doc[gap:] == doc[:-gap]
                    x, y = t[:-gap][same], t[gap:][same]
                    for one, other in ((x, y), (y, x)):
                        for k in range(NONZERO):
                            total += np.bincount(one * DIMS + place[other, k], sign[other, k], BUCKETS * DIMS)
        met = np.flatnonzero(uses)
        sums = total.reshape(BUCKETS, DIMS)[met].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(uses[met]), *[pa.array(c) for c in sums.T.copy()]],
                                         ["bucket", "uses", *columns])

    parts = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "bucket long, uses long, " + ", ".join(f"{c} long" for c in columns))
    return parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["uses", *columns]])


def word_vectors(sums: DataFrame) -> np.ndarray:
    """The bounded table of context vectors, normalised, with frequent terms weighted down."""
    rows = sums.toPandas()
    table = np.zeros((BUCKETS, DIMS), np.float32)
    if len(rows):
        raw = rows[[f"v{i}" for i in range(DIMS)]].to_numpy(np.float64)
        raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        table[rows["bucket"].to_numpy()] = raw
    return table


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id`` and ``features``, the pooled vector as float32 bytes."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = []
            for a, b in chunks(offsets):
                t, doc = terms(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                out.append(_pool(table.value, t, doc, b - a))
            rows = np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             ["doc_id", "features"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, features binary")


def _pool(table: np.ndarray, t: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    count = np.bincount(doc, minlength=n).astype(np.float64)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    there = doc[starts]
    total, square = np.zeros((n, DIMS)), np.zeros((n, DIMS))
    near, self_near = np.zeros(n), np.zeros(n)
    if len(t):
        v = table[t]
        total[there] = np.add.reduceat(v, starts, axis=0, dtype=np.float64)
        square[there] = np.add.reduceat(v * v, starts, axis=0, dtype=np.float64)
        same = doc[1:] == doc[:-1]
        near = np.bincount(doc[1:][same], np.einsum("ij,ij->i", v[1:], v[:-1])[same], n)
        self_near = np.bincount(doc[1:][same], (t[1:] == t[:-1])[same].astype(np.float64), n)
    per = np.maximum(count, 1)[:, None]
    mean = total / per
    spread = np.sqrt(np.maximum(square / per - mean * mean, 0))
    pairs = np.maximum(count - 1, 1)
    return np.column_stack([mean, spread, near / pairs, self_near / pairs, np.log1p(count) / 10]).astype(np.float32)


class Network:
    """Features -> ``HIDDEN`` rectified units -> one logit, fitted by Adam on the log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, used = order[:len(y) // 5], order[len(y) // 5:]
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-6
        d = x.shape[1]
        p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, s, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        z = (x[used] - self.mean) / self.scale
        for _ in range(EPOCHS):
            mixed = rng.permutation(len(used))
            for at in range(0, len(used), 256):
                rows = mixed[at:at + 256]
                xb, yb = z[rows], y[used[rows]]
                h = np.maximum(xb @ p[0] + p[1], 0)
                g = (sigmoid(h @ p[2] + p[3][0]) - yb) / len(rows)
                gh = np.outer(g, p[2]) * (h > 0)
                grads = [xb.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]
                step += 1
                for i, gr in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * gr
                    s[i] = 0.999 * s[i] + 0.001 * gr * gr
                    p[i] = p[i] - 0.004 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-8)
        self.p, self.t = p, 1.0
        self.t = temperature(self.logits(x[held]), y[held])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.t)


def score_quality(docs: DataFrame, labels: DataFrame, allowed, label_col: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row: ``doc_id`` and ``score``.  ``allowed`` is a condition on ``doc_id``:
    which labelled rows may be learnt from; at most ``sample`` of them are."""
    spark = docs.sparkSession
    vectors = word_vectors(context_sums(docs, text_col))
    features = materialize(pooled(docs, vectors, id_col, text_col))
    ids, y = training_ids(labels, label_col, allowed, sample)
    chosen = spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, y, strict=True)], "doc_id long, y double")
    rows = features.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()  # bounded: `sample`
    y = rows["y"].to_numpy(np.float64)
    if len(np.unique(y)) < 2:
        rate = float(y.mean()) if len(y) else 0.5
        return features.select("doc_id", F.lit(rate).alias("score"))
    net = spark.sparkContext.broadcast(Network(np.array([np.frombuffer(f, np.float32) for f in rows["features"]], np.float64), y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(f, np.float32) for f in batch.column(1).to_pylist()], np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.value.scores(x))], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")
