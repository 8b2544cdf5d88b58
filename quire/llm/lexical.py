"""Ranked lexical search: exact top-k of a set of queries over all documents by norm buckets.

A document is an impact vector: for each term of the queries it holds, an integer impact (the
saturated term frequency of BM25).  A query's score is an inner product with its terms' weights
``w``; with the weight split evenly between both sides (coordinates ``sqrt(w)`` and
``sqrt(w) * impact``) the Cauchy-Schwarz inequality bounds it by the product of two lengths.

1. One scan cuts texts into terms and keeps, per document, its length in terms and the counts of
   the queries' terms (``term_counts``): a narrow table, written.  Document counts and totals
   are sums over it.
2. Impacts and lengths are added and the table is written in order of length, the longest first
   (a range partitioning; equal lengths are split by row).  Parquet keeps the least and largest
   length of every row group, so a filter on length skips whole groups unread.
3. Scoring reads it in buckets of rows of similar length.  A query skips a bucket when its own
   length times the bucket's largest can't reach the query's threshold.  Inside, terms whose
   largest impacts together (or whose part of the query's length times the bucket's) stay below the threshold are
   set aside; only documents with one of the other terms are candidates, and those whose partial
   score plus the bound of the rest stays below are dropped.  Survivors are rescored in 64-bit
   integers.
4. A threshold is the k-th best of any part of the documents.  Ever smaller parts (an eighth of an
   eighth ...) are drawn by a hash; the smallest is scored first, and each part's k-th best is the
   threshold of the next larger one, the last being all documents.  Every step passes on about
   8 k rows a query, whatever the number of documents or tasks, and no document is left out:
   the threshold carries id and row too, so equal scores don't multiply.

Queries are taken in blocks of at most ``BLOCK_BYTES`` of text, each block's terms, weights and
thresholds being all that is collected and broadcast.  Tasks hold one batch of rows.

Defined cases: null or empty texts have no terms (they count nowhere and match nothing); an
item without terms, or one that matches nothing, gives no rows; each of repeated items is
answered for itself, and repeated documents are ranked once each; ties go to the lesser id, null
ids last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import _CLASS, materialize, small_batches, text_buffer, token_hashes, unit_hash

TOP = 50
SHARE = 8                      # each part of the documents is an eighth of the next
FIRST_PART = 4096              # documents of the smallest part, about
BLOCK_BYTES = 32 << 20         # text of the queries answered at once
WINDOW = 2_000_000             # bytes of text cut into terms at once
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Terms of one short text in order; ``bytes.lower`` folds ASCII letters only."""
    return TERM.findall((text or "").encode("utf-8", "replace").lower())


# ---------------------------------------------------------------- counting terms
@dataclass
class Vocabulary:
    """The queries' terms, ordered by hash."""
    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, terms: list[bytes]) -> Vocabulary:
        """``number`` gives each entry's place in ``terms``."""
        lengths = np.array([len(t) for t in terms], np.int64)
        offsets = np.append(0, lengths.cumsum())
        data = np.frombuffer(b"".join(terms), np.uint8)
        hashes, which, starts, _ = token_hashes(data, offsets)
        order = np.argsort(hashes, kind="stable")
        return cls(hashes[order], data, starts[order], lengths[which][order], which[order])

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the tokens' terms, -1 where they are none.  Equal hashes are compared byte by byte."""
        out = np.full(len(hashes), -1, np.int64)
        at, end = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        while True:
            look = np.flatnonzero((at < end) & (out < 0))
            if not len(look):
                return out
            entry = at[look]
            same = self.lengths[entry] == lengths[look]
            look, entry = look[same], entry[same]
            size = lengths[look]
            begin = np.append(0, size.cumsum())
            place = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
            token = data[np.repeat(starts[look], size) + place]
            token = np.where((token >= 0x41) & (token <= 0x5A), token + 32, token)
            equal = token == self.data[np.repeat(self.starts[entry], size) + place]
            if len(look):
                hit = np.logical_and.reduceat(equal, begin[:-1])
                out[look[hit]] = self.number[entry[hit]]
            at = at + 1


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a batch's bytes that end where a text ends or at a byte outside terms."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + WINDOW)
        if b < n:
            text_end = offsets[np.searchsorted(offsets, b, "right") - 1]
            if text_end > a:
                b = int(text_end)
            else:
                part = np.flatnonzero(_CLASS[data[a:b]] != 1)
                if len(part):
                    b = a + int(part[-1]) + 1
                else:                              # one term beyond the window: to its end
                    stop = int(offsets[np.searchsorted(offsets, a, "right")])
                    part = np.flatnonzero(_CLASS[data[b:stop]] != 1)
                    b = b + int(part[0]) + 1 if len(part) else stop
        yield a, b
        a = b


def count_terms(vocabulary: Vocabulary, n_terms: int, data: np.ndarray, offsets: np.ndarray):
    """Per text its terms (with repeats), then (text, term number, count) of the queries' terms."""
    n_texts = len(offsets) - 1
    size = np.zeros(n_texts, np.int64)
    keys = []
    for a, b in _windows(data, offsets):
        hashes, doc, starts, lengths = token_hashes(data[a:b], np.clip(offsets - a, 0, b - a))
        word = _CLASS[data[a:b][starts]] == 1
        hashes, doc, starts, lengths = hashes[word], doc[word], starts[word], lengths[word]
        size += np.bincount(doc, minlength=n_texts)
        number = vocabulary.find(hashes, data[a:b], starts, lengths)
        known = number >= 0
        keys.append(np.unique(doc[known] * n_terms + number[known], return_counts=True))
    if not keys:
        z = np.zeros(0, np.int64)
        return size, z, z, z
    key, count = np.concatenate([k for k, _ in keys]), np.concatenate([c for _, c in keys])
    key, inverse = np.unique(key, return_inverse=True)       # a text may lie in several windows
    count = np.bincount(inverse, count, len(key)).astype(np.int64)
    return size, key // n_terms, key % n_terms, count


_COUNTS = "row long, doc_id long, n long, terms array<int>, counts array<int>"


def _lists(doc: np.ndarray, values: np.ndarray, n_texts: int) -> pa.Array:
    offsets = np.searchsorted(doc, np.arange(n_texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def term_counts(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, n, terms, counts)`` of every document with a term; ``terms`` holds places
    in the list given, ``n`` counts all its terms."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            size, doc, term, n = count_terms(vocabulary.value, max(1, len(terms)), data, offsets)
            some = np.flatnonzero(size)
            out = pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(size))), batch.column(0), pa.array(size), _lists(doc, term, len(size)),
                 _lists(doc, n, len(size))], ["row", "doc_id", "n", "terms", "counts"])
            row += len(size)
            yield out.take(pa.array(some))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(count, _COUNTS)


# ---------------------------------------------------------------- statistics, weights, impacts
@dataclass
class Statistics:
    """Documents with a term, their terms with repeats, and of each query term its documents."""
    n_docs: int
    n_terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(d) + 1))) for d in self.df], np.int64)

    def impacts(self, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def statistics(counts: DataFrame, n_terms: int) -> Statistics:
    """Sums over the table of ``term_counts``, added up in the tasks first."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
            docs += batch.num_rows
            total += int(batch.column(0).to_numpy().sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [-1, -2]])),
                                          pa.array(np.concatenate([df[held], [docs, total]]))], ["term", "n"])

    found = (counts.select("n", "terms").mapInArrow(sums, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    got = dict(zip(found["term"].to_pylist(), found["n"].to_pylist(), strict=True))
    return Statistics(got.get(-1, 0), got.get(-2, 0), np.array([got.get(i, 0) for i in range(n_terms)], np.int64))


_IMPACTS = "row long, doc_id long, length double, terms array<int>, impacts array<int>"


def impact_vectors(counts: DataFrame, known: Statistics) -> DataFrame:
    """``(row, doc_id, length, terms, impacts)`` of documents that hold a query term, the longest first."""
    shared = counts.sparkSession.sparkContext.broadcast((known, known.weights().astype(np.float64)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for batch in batches:
            terms, n = batch.column(3), batch.column(2).to_numpy()
            number, size = terms.flatten().to_numpy(), np.diff(terms.offsets.to_numpy())
            x = known.impacts(np.repeat(n, size), batch.column(4).flatten().to_numpy().astype(np.int64))
            doc = np.repeat(np.arange(len(n)), size)
            length = np.sqrt(np.bincount(doc, weight[number] * x.astype(np.float64) ** 2, len(n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length), _lists(doc, number, len(n)),
                                              _lists(doc, x, len(n))], ["row", "doc_id", "length", "terms", "impacts"])

    out = counts.filter(F.size("terms") > 0).mapInArrow(vectors, _IMPACTS).filter("length > 0")
    return out.orderBy(F.desc("length"), F.xxhash64("row"))


# ---------------------------------------------------------------- buckets
@dataclass
class Query:
    """An item's terms with their weights, and the least (score, -id, -row) that still counts."""
    terms: np.ndarray
    weights: np.ndarray
    least: tuple[int, int, int] | None = None     # the k-th best so far: score, id, row

    def length(self) -> float:
        return math.sqrt(float(self.weights.sum()))

    def threshold(self) -> int:
        return max(1, self.least[0] if self.least else 1)


LAST_ID = np.iinfo(np.int64).max                  # stands for a null id


class Bucket:
    """Rows of similar length, with their entries also by term."""

    def __init__(self, batch: pa.RecordBatch):
        terms = batch.column(3)
        self.offsets = terms.offsets.to_numpy().astype(np.int64)
        self.offsets = self.offsets - self.offsets[0]
        self.rows = batch.column(0).to_numpy()
        self.ids = batch.column(1).fill_null(LAST_ID).to_numpy()
        self.squares = batch.column(2).to_numpy() ** 2
        self.length = float(batch.column(2).to_numpy().max())
        number, self.impacts = terms.flatten().to_numpy(), batch.column(4).flatten().to_numpy().astype(np.int64)
        self.own, self.term = np.unique(number, return_inverse=True)
        by_term = np.argsort(self.term, kind="stable")
        self.begin = np.searchsorted(self.term[by_term], np.arange(len(self.own) + 1))
        self.docs = np.repeat(np.arange(len(self.rows)), np.diff(self.offsets))[by_term]
        self.by_term = self.impacts[by_term]
        self.largest = np.maximum.reduceat(self.by_term, self.begin[:-1])

    def rescore(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``weight`` holds the query's weight of each of the bucket's terms."""
        size = self.offsets[docs + 1] - self.offsets[docs]
        begin = np.append(0, size.cumsum())
        entry = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(self.offsets[docs], size)
        return np.add.reduceat(weight[self.term[entry]] * self.impacts[entry], begin[:-1])

    def search(self, q: Query) -> tuple[np.ndarray, np.ndarray]:
        """Rows that reach the query's threshold, and their scores."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, slack = q.threshold(), 1 + 1e-9
        if q.length() * self.length * slack < least:                          # Cauchy-Schwarz: the whole bucket
            return none
        place = np.searchsorted(self.own, q.terms)
        here = self.own[np.minimum(place, len(self.own) - 1)] == q.terms
        place, weight = place[here], q.weights[here]
        bound = weight * self.largest[place]
        if bound.sum() < least:
            return none
        # terms set aside: the longest run of smallest bounds that can't reach the threshold alone
        order = np.argsort(bound, kind="stable")
        place, weight, bound = place[order], weight[order], bound[order]
        rest = np.minimum(bound.cumsum(), np.sqrt(weight.cumsum()) * self.length * slack)
        aside = int(np.searchsorted(rest, least, "left"))
        partial, square = np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows))
        for t, w in zip(place[aside:], weight[aside:], strict=True):
            span = slice(self.begin[t], self.begin[t + 1])
            x = self.by_term[span]
            partial[self.docs[span]] += w * x
            square[self.docs[span]] += w * x.astype(np.float64) ** 2
        docs = np.flatnonzero(partial)
        if aside:                                                             # coordinate bounds of the rest
            left = np.sqrt(np.maximum(0.0, self.squares[docs] * slack - square[docs]) * float(weight[:aside].sum())) * slack
            docs = docs[partial[docs] + np.minimum(left, float(bound[:aside].sum())) >= least]
            if not len(docs):
                return none
        every = np.zeros(len(self.own), np.int64)
        every[place] = weight
        score = self.rescore(docs, every) if len(docs) else docs
        keep = score >= least
        if q.least:
            s, i, r = q.least
            d = docs
            keep &= (score > s) | (self.ids[d] < i) | ((self.ids[d] == i) & (self.rows[d] <= r))
        return docs[keep], score[keep]


class Best:
    """The best rows of one query so far; its k-th becomes the query's threshold."""

    def __init__(self, query: Query, top: int):
        self.query, self.top = query, top
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, bucket: Bucket) -> None:
        docs, score = bucket.search(self.query)
        if len(docs):
            self.parts.append(np.stack([score, bucket.ids[docs], bucket.rows[docs]]))
            self.n += len(docs)
            if self.n >= 2 * self.top:
                self.ranked()

    def ranked(self) -> np.ndarray:
        """(score, id, row) of the best, in columns."""
        if not self.parts:
            return np.zeros((3, 0), np.int64)
        found = np.concatenate(self.parts, axis=1)
        found = found[:, np.lexsort((found[2], found[1], -found[0]))[:self.top]]
        self.parts, self.n = [found], found.shape[1]
        if self.n == self.top:
            self.query.least = tuple(int(v) for v in found[:, -1])
        return found


_FOUND = "item int, score long, doc_id long, row long"


def _search(vectors: DataFrame, queries: Broadcast, thresholds: list, top: int) -> DataFrame:
    """Rows that reach their queries' thresholds: the best of each task, then of all."""
    reach = [max(1, t[0]) / length if length else math.inf for t, length in zip(
        [t or (1,) for t in thresholds], [q.length() for q in queries.value], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(Query(q.terms, q.weights, t), top) for q, t in zip(queries.value, thresholds, strict=True)]
        for batch in batches:
            if batch.num_rows:
                bucket = Bucket(batch)
                for b in best:
                    b.add(bucket)
        for item, b in enumerate(best):
            score, ids, rows = b.ranked()
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item, np.int32)), pa.array(score), pa.array(ids), pa.array(rows)],
                                                 ["item", "score", "doc_id", "row"])

    # no query reaches its threshold below this length: row groups beyond it are not read
    found = vectors.filter(F.col("length") >= min(reach) * (1 - 1e-6)).mapInArrow(run, _FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _answer(spark: SparkSession, docs: DataFrame, texts: list[str | None], top: int, **columns: str) -> DataFrame:
    """``(item, rank, doc_id, score)`` for a block of queries."""
    own = [sorted(set(terms_of(t))) for t in texts]
    terms = sorted(set().union(*own))
    place = {t: i for i, t in enumerate(terms)}
    counts = materialize(term_counts(docs, terms, **columns))
    known = statistics(counts, len(terms))
    weights = known.weights()
    queries = spark.sparkContext.broadcast([Query(number, weights[number]) for number in (
        np.array([place[t] for t in mine if weights[place[t]] > 0 and known.df[place[t]]], np.int64) for mine in own)])
    vectors = materialize(impact_vectors(counts, known))
    parts = [vectors]
    while known.n_docs / SHARE ** (len(parts) - 1) > FIRST_PART:
        chance = unit_hash(F.col("row"), "part") < 1 / SHARE ** len(parts)
        parts.append(materialize(parts[-1].filter(chance)))
    thresholds: list = [None] * len(own)
    for part in reversed(parts[1:]):
        if part is parts[-1]:
            part = part.coalesce(4)                     # some thousand rows: few lists of the best to merge
        found = _search(part, queries, thresholds, top)
        for r in found.filter(F.col("rank") == top).collect():
            thresholds[r["item"]] = (r["score"], r["doc_id"], r["row"])
    return _search(vectors, queries, thresholds, top).select(
        "item", "rank", F.nullif(F.col("doc_id"), F.lit(int(LAST_ID))).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, item_col: str = "item_id", item_text_col: str = "text",
                   id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: every item's ``top`` documents of score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(items[item_col].alias("item_id"), items[item_text_col].cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // block_bytes
    schema = f"item int, item_id {items.schema['item_id'].dataType.simpleString()}"
    answers = []
    for b in range(n_blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect() if n_blocks > 1 else items.collect()
        if any(terms_of(r["text"]) for r in mine):
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], schema)
            found = _answer(spark, docs, [r["text"] for r in mine], top, id_col=id_col, text_col=text_col)
            answers.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not answers:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, answers)
