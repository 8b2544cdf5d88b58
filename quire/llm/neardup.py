"""Near-duplicates by Order MinHash, verified by banded alignment.

1. Exact copies collapse first: equal texts share a class and only their least ``doc_id`` goes on.
2. Sketch.  A text's k-mers (``WORDS`` words, case folded) are labelled with their occurrence
   number.  Each of ``SKETCHES`` hash functions picks the ``PICK`` least labelled k-mers; kept in
   text order, their hash is a bucket.  Two texts share a bucket only if they share the picked
   k-mers in the same order, which follows edit similarity rather than set overlap.
3. Candidates.  In buckets of at most ``SMALL`` texts all pairs are candidates.  A text of larger ones
   is compared with the least id, the pivot, of its largest bucket.  A large bucket whose texts are then
   of one class is settled.  All texts of the others are compared exactly: texts that may be linked share one of their rarest
   pairs of neighbouring words, ``1 + 2 * words * (1 - SIMILARITY)`` of each in one order for all (the
   prefix filter of set similarity joins; an edit undoes at most two pairs), so these are blocks.  Where
   they hold many pairs of two classes, ``LEVELS`` - 1 rounds first compare a block's rows with a new
   pivot, which brings groups of near copies together at one comparison a text, until most are unlike it.  Then every pair of a
   block that is of two classes still and that the lengths and a bound on common words do not rule out
   is a candidate.  Blocks of more than ``PART`` rows with the same largest class are one block, of that
   class and all others in them: texts that share most of a long passage meet under many pairs of words,
   but take one row.  Their texts are dealt anew into blocks by their ``1 + words * (1 - SIMILARITY)``
   rarest words, which reach beyond the passage, large ones joined likewise, split by length and compared
   in salted parts.  So every link between texts that share a bucket is found, or its ends are of one
   class anyway; no pair is dropped but by a bound.
4. Verification.  A candidate is a link if 1 - (word edit distance / words of the longer text) is
   ``SIMILARITY`` or more: the exact distance from a banded bit-vector alignment.
5. Classes are the connected components of the links; the class id is its least ``doc_id``.

Texts cross the network twice, compressed, for candidates only after the first; hot copies and
buckets are aggregated before the shuffle or split by adaptive joins.

Defined cases: null text counts as empty, and all empty texts are copies of each other; texts of
fewer than ``WORDS`` words have one k-mer, the whole text; rows that repeat a ``doc_id`` are one
document (of several texts under one id, each is sketched, one is compared); rows without
``doc_id`` get the class of their text, null if no row of it has an id, and are not dropped; an
empty table gives no rows; other columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import POWERS, materialize, mix, narrow, small_batches
from quire.llm.components import components

WORDS, PICK, SKETCHES, SIMILARITY = 5, 2, 48, 0.8
#: Buckets of so many texts are compared pair by pair at once; rounds of pivots before all pairs are.
SMALL, LEVELS = 6, 3
#: Texts of one part of a block; slots of the counts that order k-mers; 64-bit words of a text's bit set.
PART, SLOTS, BITS = 256, 1 << 20, 8

_SEEDS = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# ---------------------------------------------------------------- sketches
def labelled_kmers(words: list[str], k: int = WORDS) -> np.ndarray:
    """A 64-bit hash per k-mer of a text, in text order, that tells its occurrences apart."""
    if not words:
        return np.zeros(0, np.uint64)
    w = word_hashes(words)
    n = max(1, len(w) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(w))):
        h = mix(h * np.uint64(31) + w[i:i + n])
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    place = np.arange(n)
    nth = np.empty(n, np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return mix(h + nth * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash per word (none holds a space): its bytes times powers, summed and mixed."""
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    gaps = np.flatnonzero(data == 0x20)
    starts = np.concatenate([[0], gaps + 1])
    spans = np.diff(starts, append=len(data) + 1)
    place = np.arange(len(data)) - np.repeat(starts, spans)[:len(data)]
    value = (data.astype(np.uint64) + np.uint64(1)) * POWERS[place & 4095]
    value[gaps] = 0
    return mix(np.add.reduceat(value, starts) + spans.astype(np.uint64))


def order_minhash(kmers: np.ndarray, pick: int = PICK, sketches: int = SKETCHES) -> np.ndarray:
    """``sketches`` bucket hashes: per hash function the least k-mers, hashed in text order."""
    if len(kmers) == 0:
        return np.zeros(0, np.uint64)
    seeds = _SEEDS[:sketches, None]
    best = []
    for at in range(0, len(kmers), 8192):                    # memory stays bounded for long texts
        part = kmers[None, at:at + 8192]
        h = (part ^ seeds) * seeds
        h ^= h >> np.uint64(29)
        take = min(pick, h.shape[1])
        places = np.argpartition(h, take - 1, axis=1)[:, :take]
        best.append((np.take_along_axis(h, places, 1), places + at))
    values, places = (np.concatenate(x, axis=1) for x in zip(*best, strict=True))
    least = np.argsort(values, axis=1, kind="stable")[:, :pick]
    places = np.sort(np.take_along_axis(places, least, 1), axis=1)
    out = seeds[:, 0].copy()
    for i in range(places.shape[1]):
        out = mix(out * np.uint64(31) + kmers[places[:, i]])
    return out


def _normal(text: str | None) -> list[str]:
    return (text or "").lower().split()


# ---------------------------------------------------------------- alignment
def banded_distance(a: list[str], b: list[str], limit: int) -> int:
    """The edit distance of two word lists if it is ``limit`` or less, else ``limit`` + 1.

    A bit vector holds the vertical differences of one column of the alignment within a band of
    ``limit`` rows on either side of the diagonal, and slides down with the columns.  Cells beyond
    the band are taken as one more than their neighbours inside, which some path costs, so values
    in the band are exact as far as they are ``limit`` or less."""
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[:len(a) - end], b[:len(b) - end]
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    rows, columns = len(a), len(b)
    if abs(rows - columns) > limit:
        return limit + 1
    if not rows or not columns:
        return max(rows, columns)
    at: dict[str, int] = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << i
    width = 2 * limit + 1
    full = (1 << width) - 1
    plus, minus, low, above = full, 0, 1, 0                  # the band's first row; the value over it
    for j in range(1, columns + 1):
        if j - limit > low:
            above += (plus & 1) - (minus & 1)
            plus, minus, low = plus >> 1 | 1 << (width - 1), minus >> 1, low + 1
        above += 1
        match = at.get(b[j - 1], 0) >> (low - 1) & full
        eq = match | minus
        diagonal = (((eq & plus) + plus) ^ plus | eq) & full
        right = (minus | ~(diagonal | plus)) & full
        left = diagonal & plus
        right = (right << 1 | 1) & full
        left = left << 1 & full
        plus, minus = left | ~(right | diagonal) & full, right & diagonal
        if j % 64 == 0 and columns - j > 32 and _least_end(plus, minus, low, above, rows, columns - j, width) > limit:
            return limit + 1
    own = (1 << (rows - low + 1)) - 1
    distance = above + (plus & own).bit_count() - (minus & own).bit_count()
    return min(distance, limit + 1)


def _least_end(plus: int, minus: int, low: int, above: int, rows: int, after: int, width: int) -> int:
    """The least distance that a column of the band leaves room for, with ``after`` columns to come:
    a cell's value and the insertions or deletions that its rows and columns to come differ by."""
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes((width + 7) // 8, "little"), np.uint8), bitorder="little")
    end = min(width, rows - low + 1)
    steps = bits(plus)[:end].astype(np.int64) - bits(minus)[:end]
    value = above + np.concatenate([[0], np.cumsum(steps)])
    return int((value + np.abs(rows - low + 1 - np.arange(end + 1) - after)).min())


def is_linked(a: list[str], b: list[str], similarity: float) -> bool:
    """Whether the edit distance is at most ``1 - similarity`` of the longer list.  It is at least
    the longer list less the common words, which is told before any alignment."""
    longer = max(len(a), len(b))
    allowed = int((1 - similarity) * longer + 1e-9)
    if longer - min(len(a), len(b)) > allowed or longer - sum((Counter(a) & Counter(b)).values()) > allowed:
        return False
    return banded_distance(a, b, allowed) <= allowed


# ---------------------------------------------------------------- the job
def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                digest = hashlib.md5((text or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                sketches.append(order_minhash(labelled_kmers(_normal(text))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                              pa.array(sketches, pa.binary())], ["doc_id", "h1", "h2", "sketch"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, sketch binary")


def _buckets(texts: DataFrame) -> DataFrame:
    """(id, bucket) of every sketch entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sketches])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([*sketches, np.zeros(0, np.int64)]))],
                                             ["id", "bucket"])

    return texts.select("id", "sketch").mapInArrow(run, "id long, bucket long")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (id, bucket) of buckets with two texts or more, with their size and pivot."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"))
    return rows.join(sizes.filter("n > 1"), "bucket")


def _all_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) within buckets that are small."""
    lists = rows.groupBy("bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(
        F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a <> b")


def _bodies(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(id, body): compressed texts of the wanted ids, one for an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], ["id", "body"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).filter("id is not null")
    one = rows.mapInArrow(run, "id long, body binary").groupBy("id").agg(F.first("body").alias("body"))
    return one.join(wanted, "id", "left_semi")


def _compare(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the candidate pairs that are links.  Pivots are at ``a``, whose join is split where
    skewed; the second join is dealt by ``b`` in a set number of parts, as pairs take time, not bytes."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a").repartition(parts, "b").join(
        bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b").select("a", "b", "body_a", "body_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def words(body: bytes) -> list[str]:
            return _normal(unpack.decompress(body).decode("utf-8", "surrogatepass"))

        last, own = None, []                                 # rows of one b follow each other
        for batch in batches:
            linked = []
            for b, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if b != last:
                    last, own = b, words(y)
                linked.append(is_linked(words(x), own, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def gram(similarity: float) -> int:
    """Words of a block key: 2 if linked texts are bound to share a pair of neighbouring words.  With
    t = 1 - similarity, edits undo at most 2 t words of the words - 1 pairs of a text, and the shorter of two
    texts that are an edit apart has (1 - t) / t words or more, so one is left if (1 - 2 t)(1 - t) >= 2 t."""
    t = 1 - similarity
    return 2 if (1 - 2 * t) * (1 - t) >= 2 * t else 1


def _labelled(body: bytes, unpack: zstandard.ZstdDecompressor, *ks: int) -> list[np.ndarray]:
    words = _normal(unpack.decompress(body).decode("utf-8", "surrogatepass"))
    return [labelled_kmers(words, k) for k in ks]


def _slot(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(SLOTS)).astype(np.int64)


def _gram_counts(bodies: DataFrame, k: int) -> np.ndarray:
    """How often the k-mers of each slot occur: a bounded table that tells common ones from rare ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                slot, n = np.unique(_slot(*_labelled(body, unpack, k)), return_counts=True)
                total[slot] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["slot", "n"])

    found = bodies.select("body").mapInArrow(run, "slot long, n long").groupBy("slot").agg(
        F.least(F.sum("n"), F.lit(2 ** 31 - 1)).cast("int").alias("n")).select(F.col("slot").cast("int"), "n").toArrow()
    out = np.zeros(SLOTS, np.int32)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _profiles(bodies: DataFrame, similarity: float, k: int) -> DataFrame:
    """(id, words, bits, keys): length, parity bits of the words, and the rarest k-mers of each text."""
    counts = bodies.sparkSession.sparkContext.broadcast(_gram_counts(bodies, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            n, bits, keys = [], [], []
            for body in batch.column(1).to_pylist():
                w, g = _labelled(body, unpack, 1, k)
                odd = np.bincount((w >> np.uint64(32)).astype(np.int64) % (64 * BITS), minlength=64 * BITS) & 1
                n.append(len(w))
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                order = np.lexsort((g, counts.value[_slot(g)]))[:int(k * (1 - similarity) * len(w) + 1e-9) + 1]
                keys.append(g[order].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64())),
                                              pa.array(keys, pa.list_(pa.int64()))], ["id", "words", "bits", "keys"])

    return bodies.select("id", "body").mapInArrow(run, "id long, words long, bits array<bigint>, keys array<bigint>")


def _may_link(x: str, y: str, similarity: float) -> Column:
    """Whether the lengths and the bits of sides ``x`` and ``y`` leave room for a link: common words
    are (words of both - words of one only) / 2 and at least the longer text less its allowed edits."""
    n, m = F.col(f"{x}.words"), F.col(f"{y}.words")
    apart = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(BITS)), F.lit(0))
    least = F.greatest(n, m) * F.lit(similarity) - F.lit(1e-6)
    return (F.least(n, m) >= least) & ((n + m - apart) / 2 >= least)


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``class``: the least id that links so far join with a row's id."""
    own = classes.select(F.col("node").alias("id"), F.col("component").alias("_class"))
    return rows.join(own, "id", "left").withColumn("class", F.coalesce("_class", "id")).drop("_class")


def _of_two_classes(rows: DataFrame, key: str) -> DataFrame:
    """The groups that have more than one class, with their size."""
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("_low"), F.max("class").alias("_high"))
    return groups.filter("_low <> _high").drop("_low", "_high")


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """The rows of groups that have more than one class, with the group's size."""
    return rows.join(_of_two_classes(rows, key), key)


def _mixed_ids(rows: DataFrame, key: str) -> DataFrame:
    """The ids in groups that have more than one class."""
    return narrow(rows.join(_of_two_classes(rows, key), key, "left_semi").select("id").distinct())


def _largest_class(rows: DataFrame) -> DataFrame:
    """(key, n, top): of blocks of two classes or more the size and the largest class, with its own size and least id."""
    sizes = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least"))
    return sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", (-F.col("least")).alias("_first"), "least", "class")).alias("top"),
                                    F.count(F.lit(1)).alias("_classes")).filter("_classes > 1").drop("_classes")


def _blocks(profiles: DataFrame, classes: DataFrame, over: int) -> tuple[DataFrame, DataFrame]:
    """(key, id, class, n) twice: the blocks of at most ``over`` texts of a rare k-mer, and the larger ones, of which those
    with the same largest class are one: that class, once, and all texts of other classes that share a k-mer's block
    with it.  So texts that meet under many k-mers of a long passage take one row, not one for each k-mer."""
    texts = _classed(profiles.select("id", "keys"), classes)
    rows = texts.select("id", "class", F.explode("keys").alias("key"))
    joined = F.col("n") > over
    found = materialize(narrow(rows.join(_largest_class(rows), "key").filter(~joined | (F.col("class") != F.col("top.class"))).select(
        F.when(joined, F.col("top.class")).otherwise(F.col("key")).alias("key"), "id", "class",
        F.when(~joined, F.col("n")).alias("n")).distinct()))
    outside = found.filter("n is null").select("key", "id", "class")
    own, met = _classed(profiles.select("id"), classes), outside.select(F.col("key").alias("class")).distinct()
    inside = own.join(met, "class", "left_semi").select(F.col("class").alias("key"), "id", "class")
    return found.filter("n is not null"), materialize(narrow(_mixed(inside.unionAll(outside), "key")))


def _pairs_of_two_classes(rows: DataFrame) -> int:
    """How many pairs of the same block are of two classes."""
    of = rows.groupBy("key", "class").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    return int(of.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0)


def _pivoted(rows: DataFrame) -> DataFrame:
    """(key, id, pivot): the rows that are not of their block's largest class, with its least id."""
    return rows.join(_largest_class(rows), "key").filter("class <> top.class").select("key", "id", F.col("top.least").alias("pivot"))


def _with_pivots(rows: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pivots and rows that may be linked."""
    own = profiles.select("id", "words", "bits")
    return rows.select("id", "pivot").distinct().join(own.alias("x"), "id").join(
        own.alias("y"), F.col("pivot") == F.col("y.id")).filter(_may_link("x", "y", similarity)).select(
        F.col("pivot").alias("a"), F.col("x.id").alias("b"))


def _across_classes(rows: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs within a block that are of two classes and may be linked.  A block of more than
    ``PART`` rows is split by length, then dealt into parts of about ``PART``, and each pair of parts
    is a group of its own."""
    told = materialize(narrow(rows.join(profiles.select("id", "words", "bits"), "id")))
    may = (F.col("x.class") != F.col("y.class")) & _may_link("x", "y", similarity)

    def pairs(x: DataFrame, y: DataFrame, same: Column) -> DataFrame:
        return x.alias("x").join(y.alias("y"), same & may).select(
            F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    one = told.filter(F.col("n") <= PART)
    found = pairs(one, one, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    large = told.filter(F.col("n") > PART)
    if large.isEmpty():
        return found.distinct()
    # lengths of linked texts are at most one step of 1 / similarity apart, so two texts' steps meet one up
    step = F.floor(F.log(F.col("words").cast("double")) / F.lit(-np.log(similarity)) + F.lit(1e-9)) if similarity < 1 else F.col("words")
    large = materialize(_mixed(large.drop("n").withColumn("step", F.explode(F.array(step, step + 1))).withColumn(
        "key", F.xxhash64("key", "step")).drop("step"), "key"))
    parts = F.ceil(F.col("n") / F.lit(PART)).cast("long")
    dealt = large.withColumn("own", F.pmod(F.xxhash64("id"), parts)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    once = (F.col("x.own") < F.col("x.other")) | (F.col("x.id") < F.col("y.id"))
    return found.unionAll(pairs(dealt.filter("own <= other"), dealt.filter("own >= other"), met & once)).distinct()


def _classes(texts: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, small: int, levels: int) -> DataFrame:
    """(node, component): the classes of two different texts or more."""
    live = materialize(narrow(_shared(_buckets(texts))))
    bodies = materialize(_bodies(docs, id_col, text_col, live.select("id").distinct()))

    def verified(pairs: DataFrame) -> DataFrame:
        return materialize(_compare(pairs, bodies, similarity))

    def grown(classes: DataFrame, found: DataFrame) -> DataFrame:
        """The classes with the links found: texts that have a class stay one link of it."""
        if found.isEmpty():
            return classes
        return components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found))

    def settled(rows: DataFrame, profiles: DataFrame, classes: DataFrame) -> DataFrame:
        """The classes once all pairs of two classes in the blocks are compared or ruled out."""
        most, rest = small * small * profiles.count(), rows
        for _ in range(levels - 1):
            if _pairs_of_two_classes(rest) <= most:
                break
            rest = materialize(narrow(_pivoted(rest.filter(F.col("n") > small))))
            found = verified(_with_pivots(rest, profiles, similarity))
            classes = grown(classes, found)
            if 2 * found.count() < rest.count():             # mostly unlike texts, which no pivot brings together
                break
            rest = materialize(narrow(_mixed(_classed(rest.select("key", "id"), classes), "key")))   # goes on to new pivots
        left = rows if rest is rows else materialize(narrow(_mixed(_classed(rows.select("key", "id"), classes), "key")))
        return grown(classes, verified(_across_classes(left, profiles, similarity)))

    large = live.filter(F.col("n") > small)
    nearest = large.groupBy("id").agg(F.min(F.struct(-F.col("n"), "pivot")).alias("top")).select(
        F.col("top.pivot").alias("a"), F.col("id").alias("b")).filter("a <> b")
    classes = components(verified(_all_pairs(live.filter(F.col("n") <= small)).unionAll(nearest).distinct()))
    if large.isEmpty():
        return classes
    still = materialize(_mixed_ids(_classed(large.select(F.col("bucket").alias("key"), "id"), classes), "key"))
    if still.isEmpty():
        return classes
    step = gram(similarity)
    if step > 1:
        profiles = materialize(narrow(_profiles(bodies.join(still, "id", "left_semi"), similarity, step)))
        rows, large = _blocks(profiles, classes, PART)
        classes = settled(rows, profiles, classes)
        still = materialize(_mixed_ids(_classed(large.select("key", "id"), classes), "key"))
        if still.isEmpty():
            return classes
    profiles = materialize(narrow(_profiles(bodies.join(still, "id", "left_semi"), similarity, 1)))
    rows, large = _blocks(profiles, classes, small)
    return settled(materialize(narrow(rows.unionByName(large))), profiles, classes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """One row per row: ``doc_id``, ``copy_of`` (the least id of equal texts) and ``class_id``."""
    small_batches(docs.sparkSession)
    features = materialize(_features(docs, id_col, text_col))
    copies = features.groupBy("h1", "h2").agg(F.min("doc_id").alias("copy_of"))
    member = materialize(narrow(features.join(copies, ["h1", "h2"]).select(
        "doc_id", "copy_of", F.when(F.col("doc_id") == F.col("copy_of"), F.col("sketch")).alias("sketch"))))
    texts = member.filter("sketch is not null").select(F.col("doc_id").alias("id"), "sketch").dropDuplicates(["id"])
    classes = _classes(texts, docs, id_col, text_col, similarity, small, levels)
    return member.select("doc_id", "copy_of").join(classes.withColumnRenamed("node", "copy_of"), "copy_of", "left").select(
        "doc_id", "copy_of", F.coalesce("component", "copy_of").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         similarity: float = SIMILARITY) -> DataFrame:
    """The rows of one document of each class, the one of least id, with all their columns; a
    row repeated under that id stays once.  Rows without an id stay."""
    classes = near_duplicates(docs, id_col, text_col, similarity)
    told = materialize(classes.groupBy(F.col("doc_id").alias("_doc_id")).agg(
        F.max(F.col("doc_id") != F.col("class_id")).alias("_gone"), F.count(F.lit(1)).alias("_times")).filter(
        "_doc_id is not null and (_gone or _times > 1)"))
    # ids that go or repeat: few beside the texts, which are joined with these only
    key = docs[id_col].cast("long") == F.col("_doc_id")
    kept = docs.join(told, key, "left_anti")
    twice = told.filter("not _gone")
    if not twice.isEmpty():
        kept = kept.unionAll(docs.join(twice, key, "left_semi").dropDuplicates([id_col]))
    return kept
