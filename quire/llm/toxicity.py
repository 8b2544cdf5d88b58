"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed terms: words (ASCII case folded) and the first bytes of longer
words, which inflected forms share.  Its logit is a bias, a weight per term, and for every pair
of terms the product of their latent vectors, so that an insult weighs more beside a group's
name than the two weights alone say.  Pairs cost no more than terms: the sum over pairs is half
the square of the sum less the sum of squares.  Weights are learnt by AdaGrad on at most
``SAMPLE`` labelled texts; a held-back fifth of them sets the temperature of the probabilities.
The model has a fixed size (``SPACE`` x (1 + ``FACTORS``)) and is broadcast; nothing is shuffled
but the labels.

Defined cases: null text counts as empty and scores by the bias alone; repeated rows get equal
scores; an empty table gives no rows; without labels of both kinds every score is the labels'
mean (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, mix, small_batches, text_buffer, token_hashes
from quire.llm.labels import sigmoid, temperature, training_ids

SPACE, FACTORS, PREFIXES = 1 << 18, 4, (4, 5, 6)
#: Labelled texts that the machine is fitted on, at most.
SAMPLE = 20_000
EPOCHS, BATCH, RATE = 10, 64, 0.2
#: Terms that learn: in so many of the sample's texts at least, and with shares of the two
#: classes so many standard errors apart.  Other terms could only learn single texts by heart.
LEAST_TEXTS, LEAST_Z = 5, 3.0


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) pairs without repeats, sorted by text."""
    hashes, doc, starts, lengths = token_hashes(data, offsets)
    owners, terms = [doc], [hashes]
    prefix = np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        byte = data[np.minimum(starts + k, len(data) - 1)] if len(starts) else data[:0]
        lower = np.where((byte >= 0x41) & (byte < 0x5B), byte + 32, byte)
        prefix = prefix * np.uint64(257) + lower.astype(np.uint64) + np.uint64(1)
        if k + 1 in PREFIXES:
            long = lengths > k + 1
            owners.append(doc[long])
            terms.append(mix(prefix[long] ^ np.uint64(0xD6E8FEB86659FD93 + k)))
    every = np.concatenate(terms) % np.uint64(SPACE)
    key = np.unique(np.concatenate(owners).astype(np.int64) * SPACE + every.astype(np.int64))
    return key // SPACE, key % SPACE


class FactorizationMachine:
    def __init__(self, doc: np.ndarray, term: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(y)
        telling = self._telling(doc, term, y)
        doc, term = doc[telling[term]], term[telling[term]]
        order = rng.permutation(n)
        held, used = order[:n // 5], order[n // 5:]
        self.bias = 0.0
        self.w = np.zeros(SPACE)
        self.v = rng.normal(0, 0.01, (SPACE, FACTORS)) * telling[:, None]
        gw, gv, gb = np.ones(SPACE), np.ones((SPACE, FACTORS)), 1.0
        first = np.searchsorted(doc, np.arange(n + 1))
        for _ in range(EPOCHS):
            mixed = rng.permutation(used)
            for at in range(0, len(mixed), BATCH):
                rows = mixed[at:at + BATCH]
                d = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
                t = np.concatenate([term[first[r]:first[r + 1]] for r in rows])
                x = self._inputs(d, len(rows))
                logit, sums = self._logits(d, t, x, len(rows))
                g = sigmoid(logit) - y[rows]
                self.bias -= RATE * g.sum() / np.sqrt(gb := gb + g.sum() ** 2)
                gx = g[d] * x
                own, back = np.unique(t, return_inverse=True)
                dw = np.bincount(back, gx, len(own)) + 1e-4 * self.w[own]
                gw[own] += dw * dw
                self.w[own] -= RATE * dw / np.sqrt(gw[own])
                vt = self.v[t]
                part = gx[:, None] * (sums[d] - vt * x[:, None])
                dv = np.column_stack([np.bincount(back, part[:, f], len(own)) for f in range(FACTORS)]) + 1e-3 * self.v[own]
                gv[own] += dv * dv
                self.v[own] -= 0.25 * RATE * dv / np.sqrt(gv[own])
        self.t = 1.0
        self.telling = telling
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)
        keep = np.isin(doc, held)
        at = np.searchsorted(np.sort(held), doc[keep])
        self.t = temperature(self.logits(at, term[keep], len(held)), y[np.sort(held)])

    @staticmethod
    def _telling(doc: np.ndarray, term: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which terms have shares in the two classes that differ beyond chance."""
        every = np.bincount(term, minlength=SPACE)
        toxic = np.bincount(term, y[doc], SPACE)
        n, n1 = len(y), y.sum()
        share = every / n
        error = np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1))) + 1e-9
        return (every >= LEAST_TEXTS) & (np.abs(toxic / n1 - (every - toxic) / (n - n1)) >= LEAST_Z * error)

    @staticmethod
    def _inputs(d: np.ndarray, n: int) -> np.ndarray:
        """Each present term's value: less in texts with more of them."""
        return 1 / np.sqrt(1 + np.log1p(np.bincount(d, minlength=n)))[d]

    def _logits(self, d: np.ndarray, t: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[t] * x[:, None]
        sums = np.column_stack([np.bincount(d, vx[:, f], n) for f in range(FACTORS)])
        squares = np.bincount(d, (vx * vx).sum(1), n)
        return self.bias + np.bincount(d, self.w[t] * x, n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def logits(self, d: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        return self._logits(d, t, self._inputs(d, n), n)[0]

    def scores(self, d: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        known = self.telling[t]
        d, t = d[known], t[known]
        return sigmoid(self.logits(d, t, n) / self.t)


def score_toxicity(docs: DataFrame, labels: DataFrame, allowed, label_col: str = "toxic", id_col: str = "doc_id",
                   text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row: ``doc_id`` and ``score``.  ``allowed`` is a condition on ``doc_id``:
    which labelled rows may be learnt from; at most ``sample`` of them are."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ids, y = training_ids(labels, label_col, allowed, sample)
    wanted = spark.sparkContext.broadcast(ids)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(np.isin(np.array(batch.column(0).fill_null(-1)), wanted.value) & np.array(batch.column(0).is_valid()))
            batch = batch.filter(own)
            data, offsets = text_buffer(batch.column(1))
            packed = []
            for a, b in chunks(offsets):
                doc, term = text_terms(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                packed += [term[cuts[i]:cuts[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "terms"])

    seen = rows.mapInArrow(gather, "doc_id long, terms binary").toPandas()     # bounded: `sample` rows
    seen = seen.drop_duplicates("doc_id").sort_values("doc_id")
    y = y[np.searchsorted(ids, seen["doc_id"].to_numpy())] if len(seen) else y[:0]
    if len(np.unique(y)) < 2:
        return rows.select("doc_id", F.lit(float(y.mean()) if len(y) else 0.5).alias("score"))
    sets = [np.frombuffer(t, np.int32) for t in seen["terms"]]
    machine = FactorizationMachine(np.repeat(np.arange(len(sets)), [len(s) for s in sets]),
                                   np.concatenate(sets).astype(np.int64), y)
    model = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = [model.value.scores(*text_terms(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), b - a)
                   for a, b in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())],
                                             ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
