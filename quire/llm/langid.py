"""Language identification with bit-sliced Bloom filters over byte n-grams.

One Bloom filter per language, stored bit-sliced: row p of the table is a bitmask of the
languages whose filter has bit p set, so the conjunction of an n-gram's rows is the set of *all*
languages that contain it, found in one look-up whatever the number of languages.  A text's score
for a language is the popcount of that language's bit over the text's n-grams, corrected for the
hits that the filter's fill gives by chance: ``(hits - n f) / (1 - f)`` with ``f`` the share of
set bits to the power of the hash count.  The language of the largest corrected count wins.

Learning takes, of every language, at most about ``SAMPLE_DOCS`` documents, drawn by a hash of
the id with the language's own probability (so rare languages are taken whole and nothing is
sorted), counts their n-grams, and inserts those with a share of at least ``GRAM_SHARE`` of the
language's n-grams of that order, twice at least.  A language thus inserts at most
``len(ORDERS) / GRAM_SHARE`` n-grams, and the table has 8 MB for every 64 languages: this is all
that is collected and broadcast, whatever the corpus.  Scoring is one map over the scan.

N-grams are ``ORDERS`` bytes of the lower-cased text, in which everything but ASCII letters and
bytes beyond ASCII is one space between words.  Long texts are scored in blocks of their n-grams.

Defined cases: null text, or text without a letter (Unicode category L), is ``und`` with score 0;
so is every text when no language was learnt.  A tie goes to the language with more documents,
then to the lesser name; so does a text without any known n-gram (score 0).  Rows without language
or id are not learnt from, but scored; repeated rows are scored once each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mix, small_batches, text_buffer, unit_hash

UNDETERMINED = "und"
ORDERS = (3, 5)
SAMPLE_DOCS = 4000            # documents learnt of each language, in expectation
GRAM_SHARE = 2e-5             # least share of a language's n-grams of one order
ROWS = 1 << 20                # bits of each language's filter
HASHES = 4
BLOCK = 1 << 19               # n-grams looked up at once

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ---------------------------------------------------------------- texts to n-grams
def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts with single spaces between and around their words, and
    the texts' n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    padded = pc.binary_join_element_wise(none, column, none, space)
    data, offsets = text_buffer(padded)
    if not len(data):
        return data, offsets
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                       # the first other byte after a word
    keep[offsets[:-1]] = True                     # and a text's first space
    places = np.append(0, np.add.reduceat(keep, offsets[:-1], dtype=np.int64).cumsum())
    return np.where(letter, data, 0x20)[keep].astype(np.uint8), places


def grams(data: np.ndarray, a: int, b: int, order: int) -> np.ndarray:
    """The n-grams that start at places a to b, as numbers of ``order`` bytes (exact, no hash)."""
    out = np.zeros(b - a, np.uint64)
    for j in range(order):
        out |= data[a + j:b + j].astype(np.uint64) << np.uint64(8 * j)
    return out


def _blocks(data: np.ndarray, order: int) -> Iterator[tuple[int, int]]:
    last = len(data) - order + 1
    for a in range(0, max(0, last), BLOCK):
        yield a, min(last, a + BLOCK)


def _starts(offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First n-gram of each text and the place behind its last."""
    return offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - order + 1)


def rows_of(found: np.ndarray) -> Iterator[np.ndarray]:
    """The filter rows of n-grams, one array per hash function."""
    h = mix(found * np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(ROWS - 1)).astype(np.int64)


# ---------------------------------------------------------------- learning
@dataclass
class Filters:
    """The learnt table: languages, the most frequent first, and one bitmask per row and 64 of them."""
    languages: list[str]
    table: np.ndarray                             # (slices, ROWS) of uint64

    def chance(self) -> np.ndarray:
        """Of each language, the chance that an n-gram it doesn't have seems to be there."""
        fill = [np.count_nonzero(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / ROWS for i in range(len(self.languages))]
        return np.array(fill) ** HASHES


def build_filters(languages: list[str], which: np.ndarray, found: np.ndarray) -> Filters:
    """Filters that hold n-gram ``found[i]`` for language number ``which[i]``."""
    table = np.zeros(((len(languages) + 63) // 64, ROWS), np.uint64)
    for lang in np.unique(which):
        bit = np.uint64(1) << np.uint64(lang % 64)
        for rows in rows_of(found[which == lang]):
            table[lang // 64][np.unique(rows)] |= bit
    return Filters(languages, table)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c, first)


class _Counts:
    """N-gram counts of one language and order in one task, merged as they grow."""

    def __init__(self):
        self.keys, self.counts, self.pending = [], [], 0

    def add(self, found: np.ndarray) -> None:
        k, c = np.unique(found, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.pending += len(k)
        if self.pending > 4 * BLOCK:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, c = _merged(self.keys, self.counts)
            self.keys, self.counts = [k], [c]
        self.pending = 0
        return self.keys[0], self.counts[0]


_COUNTS = "lang string, n_bytes int, gram long, n long"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, n-gram, count) of the task's texts; n-gram null: all of that order."""
    per: dict[tuple[str, int], _Counts] = {}
    totals: dict[tuple[str, int], int] = {}
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for lang in pc.unique(langs).to_pylist():
            data, offsets = normalise(texts.filter(pc.equal(langs, pa.scalar(lang, langs.type))))
            for order in ORDERS:
                starts, ends = _starts(offsets, order)
                inside = np.zeros(len(data) + 1, np.int8)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                inside = np.cumsum(inside, dtype=np.int8) > 0
                for a, b in _blocks(data, order):
                    found = grams(data, a, b, order)[inside[a:b]]
                    if len(found):
                        per.setdefault((lang, order), _Counts()).add(found)
                        totals[lang, order] = totals.get((lang, order), 0) + len(found)
    for (lang, order), counts in per.items():
        keys, n = counts.merge()
        keys, n = np.append(keys.view(np.int64), 0), np.append(n, totals[lang, order])
        none = np.zeros(len(keys), bool)
        none[-1] = True
        for i in range(0, len(keys), BLOCK):
            part = slice(i, i + BLOCK)
            size = len(keys[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array(np.full(size, order, np.int32)),
                 pa.array(keys[part], mask=none[part]), pa.array(n[part].astype(np.int64))], ["lang", "n_bytes", "gram", "n"])


def learn(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, gram_share: float = GRAM_SHARE) -> Filters:
    """Filters of all languages that rows with ``allowed`` have."""
    small_batches(docs.sparkSession)
    rows = docs.filter(allowed & docs[lang_col].isNotNull() & docs[id_col].isNotNull())
    known = {r[0]: r[1] for r in rows.groupBy(docs[lang_col].cast("string").alias("lang")).count().collect()}
    languages = sorted(known, key=lambda x: (-known[x], x))
    if not languages:
        return Filters([], np.zeros((0, ROWS), np.uint64))
    chances = {x: sample_docs / known[x] for x in languages if known[x] > sample_docs}
    rows = rows.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), docs[id_col].alias("id"))
    if chances:
        chance = F.coalesce(F.create_map(*[F.lit(x) for pair in chances.items() for x in pair])[F.col("lang")], F.lit(1.0))
        rows = rows.filter(unit_hash(F.col("id"), "langid") < chance)
    counts = (rows.select("lang", "text").mapInArrow(_count_grams, _COUNTS)
              .groupBy("lang", "n_bytes", "gram").agg(F.sum("n").alias("n")))
    # most n-grams occur once or twice: the floor for the rarest is applied before anything is collected
    totals = counts.filter(F.col("gram").isNull()).select("lang", "n_bytes", F.col("n").alias("total"))
    kept = (counts.filter(F.col("gram").isNotNull() & (F.col("n") >= 2)).join(totals, ["lang", "n_bytes"])
            .filter(F.col("n") >= gram_share * F.col("total")).select("lang", "gram").toArrow())
    number = {x: i for i, x in enumerate(languages)}
    which = np.array([number[x] for x in kept["lang"].to_pylist()], np.int64)
    return build_filters(languages, which, kept["gram"].to_numpy().view(np.uint64))


# ---------------------------------------------------------------- scoring
def language_counts(filters: Filters, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language the popcounts of its n-grams' masks, and per text its n-grams."""
    n_texts, n_langs = len(offsets) - 1, len(filters.languages)
    hits, total = np.zeros((n_texts, n_langs), np.int64), np.zeros(n_texts, np.int64)
    for order in ORDERS:
        starts, ends = _starts(offsets, order)
        total += ends - starts
        for a, b in _blocks(data, order):
            rows = list(rows_of(grams(data, a, b, order)))
            # the texts of this block, and their n-grams' places in it
            first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            lo, hi = np.clip(starts[first:last] - a, 0, b - a), np.clip(ends[first:last] - a, 0, b - a)
            for s, table in enumerate(filters.table):
                mask = table[rows[0]]
                for r in rows[1:]:
                    mask &= table[r]
                for i in range(64 * s, min(64 * s + 64, n_langs)):
                    bits = np.append(0, np.cumsum((mask >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)))
                    hits[first:last, i] += bits[hi] - bits[lo]
    return hits, total


def decide(filters: Filters, chance: np.ndarray, hits: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of the winning language and its share of the n-grams, corrected."""
    corrected = np.maximum(0.0, (hits - total[:, None] * chance) / (1 - chance))
    best = np.argmax(corrected, axis=1)           # languages lie by frequency: the first of equals wins
    share = corrected[np.arange(len(best)), best] / np.maximum(total, 1)
    return best, np.clip(share, 0.0, 1.0)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((filters, filters.chance()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, chance = shared.value
        names = np.array([*filters.languages, UNDETERMINED], object)
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if filters.languages:
                hits, total = language_counts(filters, *normalise(batch.column(1)))
                best, share = decide(filters, chance, hits, total)
                best, share = np.where(lettered, best, -1), np.where(lettered, share, 0.0)
            else:
                best, share = np.full(len(lettered), -1), np.zeros(len(lettered))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(share)],
                                             ["doc_id", "lang_pred", "score"])

    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, allowed: Column, **columns: str) -> DataFrame:
    """Learn from the rows that ``allowed`` names, and label every row."""
    return identify(docs, learn(docs, allowed, **columns),
                    **{k: v for k, v in columns.items() if k in ("id_col", "text_col")})
