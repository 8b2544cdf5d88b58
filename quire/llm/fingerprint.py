"""Document fingerprints: a digest of improbable byte windows in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy; how common each entropy level is over the whole
corpus ranks the windows by rarity.  Among any ``SPAN`` neighbouring windows the rarest is the
local winner, and windows that win often enough are a text's features.  Features go, in text order
and once each, into Bloom filters of ``BITS`` bits; a full filter starts the next one of the chain.
Two digests are compared filter by filter: the bits they share, less what chance lets them share,
over what they could share, best partner first, weighted by features.

A text's neighbour is found without ordering the table in one place: bounds of id ranges come from
a narrow pass over the ids, each range is sorted on its own, and the first document of a range is
also sent to the range before it.  The corpus-wide part that is broadcast is one rank per entropy
level and one id per range.

Defined cases: null text counts as empty; an empty text has no features, is like another empty
text (1) and unlike all others (0); windows of few different characters are features only of texts that
have no others; a text shorter than a window is one feature; a null id sorts
first; rows of one id are ordered by their text; a single document is its own neighbour; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, mix, small_batches, text_buffer

WINDOW, SPAN, WINS = 32, 32, 8
BITS, FULL, HASHES = 2048, 160, 5
LEVELS = 1025
#: Windows of less entropy than this share of the most are runs of few characters: no features.
LEAST_ENTROPY = 0.15
ROWS_IN_RANGE = 5000

_COUNTS = np.arange(WINDOW + 2)
_G = np.rint(16 * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)   # exact sums of integers
_REMOVE = np.concatenate([[0], _G[:-1] - _G[1:]])
_ADD = np.concatenate([_G[1:] - _G[:-1], [0]])
_MOST = int(_G[WINDOW])
_FACTORS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def entropy_levels(data: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Per window start the entropy of its ``WINDOW`` bytes on a scale of ``LEVELS`` steps.

    Sliding a window by one byte changes the entropy by how often the leaving and the entering
    byte occur in it, which comparisons at each distance count for all windows at once."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    for at in range(0, n, block):
        part = data[at:at + block + WINDOW - 1]
        own = min(block, n - at)
        for gap in range(1, min(WINDOW, len(part))):
            m = min(own, len(part) - gap)
            same = (part[:m] == part[gap:gap + m]).view(np.uint8)
            ahead[at:at + m] += same
            behind[at + gap:at + gap + m] += same
    first = int(_G[np.bincount(data[:WINDOW], minlength=256)].sum())
    steps = _REMOVE[ahead[:n - WINDOW]] + _ADD[behind[WINDOW:]]
    total = np.concatenate([[first], first + np.cumsum(steps)])
    return (_MOST - total) * (LEVELS - 1) // _MOST


def _valid(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which window starts lie in one text."""
    ok = np.ones(max(0, n - WINDOW + 1), bool)
    for k in range(1, WINDOW):
        cut = offsets[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of the whole corpus have each entropy level."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in chunks(offsets):
                part, cuts = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                levels = entropy_levels(part)
                total += np.bincount(levels[_valid(cuts, len(part))], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "level long, n long").groupBy("level").agg(
        F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank per level: 0 for the rarest; ``LEVELS`` for levels that make no feature beside others."""
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    ranks[:int(LEAST_ENTROPY * LEVELS)] = LEVELS
    return ranks


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of a run of texts, in text order, without repeats in a text."""
    n, texts = len(data), len(offsets) - 1
    docs, hashes = [], []
    ok = _valid(offsets, n)
    if ok.any():
        rank = np.where(ok, ranks[entropy_levels(data)], LEVELS)
        key = rank << 40 | np.arange(len(rank))
        key = np.concatenate([key, np.full(SPAN, (LEVELS + 1) << 40)])
        width = 1
        while width < SPAN:                                       # minimum over SPAN by doubling
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        starts = np.flatnonzero(ok)
        winner = key[starts] & ((1 << 40) - 1)
        wins = np.bincount(winner, minlength=len(rank))
        wins[rank >= LEVELS] = 0
        place = np.flatnonzero(wins)
        doc = np.searchsorted(offsets, place, "right") - 1
        best = np.zeros(texts, np.int64)
        np.maximum.at(best, doc, wins[place])
        chosen = wins[place] >= np.minimum(WINS, best[doc])
        place, doc = place[chosen], doc[chosen]
        h = np.zeros(len(place), np.uint64)
        for i in range(WINDOW):
            h += (data[place + i].astype(np.uint64) + np.uint64(1)) * _FACTORS[i]
        docs.append(doc)
        hashes.append(mix(h))
    sizes = np.diff(offsets)
    # texts of runs of few characters only: their windows are all they have
    some = np.zeros(texts, bool)
    some[np.concatenate([*docs, np.zeros(0, np.int64)])] = True
    for i in np.flatnonzero((sizes >= WINDOW) & ~some):
        own = data[offsets[i]:offsets[i + 1]]
        _, h = features(own, np.array([0, len(own)]), np.where(ranks >= LEVELS, np.arange(LEVELS), ranks))
        docs.append(np.full(len(h), i))
        hashes.append(h)
    for i in np.flatnonzero((sizes > 0) & (sizes < WINDOW)):
        whole = data[offsets[i]:offsets[i + 1]].astype(np.uint64) + np.uint64(1)
        docs.append(np.array([i]))
        hashes.append(mix(np.array([(whole * _FACTORS[:len(whole)]).sum()], np.uint64)))
    doc = np.concatenate([*docs, np.zeros(0, np.int64)])
    h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    if len(h) == 0:
        return doc, h
    order = np.lexsort((np.arange(len(h)), h, doc))
    first = np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])])
    keep = np.sort(order[first])
    keep = keep[np.argsort(doc[keep], kind="stable")]
    return doc[keep], h[keep]


class Digest:
    """A chain of Bloom filters and how many features each holds."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n = n
        chain = np.zeros((-(-n // FULL), BITS), bool)
        link = np.arange(n) // FULL
        for k in range(HASHES):
            chain[link, (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
        self.filters = np.packbits(chain, axis=1)
        self.bits = chain.sum(1)

    def text(self) -> str:
        return f"{self.n}:{base64.b64encode(self.filters.tobytes()).decode()}" if self.n else ""


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1; 1 for equal digests."""
    if a.n == 0 or b.n == 0:
        return 1.0 if a.n == b.n else 0.0
    if len(a.bits) == len(b.bits):
        return 0.5 * (_toward(a, b) + _toward(b, a))
    return _toward(a, b) if len(a.bits) < len(b.bits) else _toward(b, a)


def _toward(a: Digest, b: Digest) -> float:
    total = 0.0
    for i, (own, bits) in enumerate(zip(a.filters, a.bits, strict=True)):
        shared = np.bitwise_count(b.filters & own).sum(1).astype(np.float64)
        chance = bits * b.bits / BITS
        most = np.minimum(bits, b.bits)
        score = np.where(most > chance, (shared - chance) / np.maximum(most - chance, 1e-9), shared >= most)
        total += min(1.0, max(0.0, float(score.max()))) * min(FULL, a.n - i * FULL)
    return total / a.n


def digests(texts: list[str], ranks: np.ndarray) -> list[Digest]:
    data, offsets = text_buffer(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()))
    out: list[Digest] = []
    for a, b in chunks(offsets):
        doc, h = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], ranks)
        cuts = np.searchsorted(doc, np.arange(b - a + 1))
        out += [Digest(h[cuts[i]:cuts[i + 1]]) for i in range(b - a)]
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _range_starts(docs: DataFrame, id_col: str) -> np.ndarray:
    """The least id of each of a number of id ranges of similar size (null: before all)."""
    ids = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("k"))
    rows = ids.count()
    ranges = max(1, -(-rows // ROWS_IN_RANGE))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.column(0).to_numpy(zero_copy_only=False).min() for b in batches if b.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(found)], pa.int64())], ["k"])

    starts = ids.repartitionByRange(ranges, "k").mapInArrow(least, "k long").collect()
    return np.sort(np.array([r["k"] for r in starts], np.int64))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_features long")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its fingerprint, that of its edited text, and how like it is to its edited
    text and to the next document by id (after the last: the first)."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(rarity_ranks(level_counts(docs, text_col)))
    found = _range_starts(docs, id_col)
    starts = spark.sparkContext.broadcast(found)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document to its range; the first of a range to the one before as well."""
        pack, last = zstandard.ZstdCompressor(level=3), len(starts.value) - 1
        for batch in batches:
            key = batch.column(1).to_numpy(zero_copy_only=False)
            body = pa.array([pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()], pa.binary())
            own = np.searchsorted(starts.value, key, "right") - 1
            heads = np.flatnonzero(starts.value[own] == key) if len(key) else own
            rows = np.concatenate([np.arange(len(key)), heads])
            to = np.concatenate([own, np.where(own[heads] > 0, own[heads] - 1, last)])
            halo = np.concatenate([np.zeros(len(key), np.int64), np.ones(len(heads), np.int64)])
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int64()), pa.array(halo), batch.column(0).take(taken), batch.column(1).take(taken), body.take(taken)],
                ["range", "halo", "doc_id", "k", "body"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held = None                                               # the row whose next one has yet to come
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in (0, 1, 2)],
                            [unpack.decompress(b).decode("utf-8", "surrogatepass") for b in batch.column(4).to_pylist()], strict=True))
            own = digests([r[3] for r in rows], ranks.value)
            line = ([held] if held else []) + list(zip(rows, own, strict=True))
            pairs = [(x, y) for x, y in zip(line, line[1:], strict=False) if x[0][0] == y[0][0] and not x[0][1]]
            changed = [edited(x[0][3], y[0][3]) for x, y in pairs]
            out = []
            for (x, y), text, d in zip(pairs, changed, digests(changed, ranks.value), strict=True):
                out.append((x[0][2], len(x[0][3]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), x[1].text(), d.text(),
                            likeness(x[1], d), likeness(x[1], y[1]), x[1].n))
            if line:
                held = line[-1]
            columns = list(zip(*out, strict=True)) or [[]] * len(TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("k"),
                       docs[text_col].cast("string").alias("text"))
    dealt = rows.mapInArrow(send, "range long, halo long, doc_id long, k long, body binary")
    return dealt.repartition(max(1, len(found)), "range").sortWithinPartitions("range", "halo", "k", "body").mapInArrow(judge, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]
