"""Fill-in-middle: texts cut at unit borders and written in another order, and put back again.

Secondary-sort assembly.  A document's text is cut into units (a word with the white space
before it; white space at the end is a unit of its own) and its three parts into pieces of whole
units.  Every piece is keyed by its row and its place in the output;
``repartitionAndSortWithinPartitions`` brings the pieces of a row together in that order, and the
digest of the output grows piece by piece, so no task holds more of a long text than one piece
and the sorter's own (spilling) buffer.  Restoration reads the assembled pieces only: the marks
among them tell which part follows, each piece is keyed by its place in the original order, and a
second sort streams them into the digest of the restored text.  A text left as it is needs no
second sort: its output is read back in the same order.

A row's key is a digest of its id and text, its input partition and its number among equal rows
there, so copies under one id don't meet in one task, and a partition read again after a lost
executor gives the same keys whatever order its rows come in.

Shuffled: every text once, the rearranged ones twice, as compressed pieces; the
number of partitions follows the text's bytes, which are summed up first.

Defined cases: null text counts as empty (plain, no units); a null id is drawn as an empty one;
each of repeated rows gives its own row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A piece ends at the last unit border within so many bytes, or inside a longer unit.
PIECE_BYTES = 1 << 17
PARTITION_BYTES = 64 << 20                    # text of a shuffled partition, about
HEADER = -1                                   # sorts before a row's pieces
DIGESTS = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, "
           "output_sha256 string, restored_sha256 string")


@dataclass(frozen=True)
class Plan:
    """How texts are drawn and marked: shares in percent, marks of prefix, suffix and middle."""
    seed: int = 42
    infill_percent: int = 50
    suffix_first_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()

    def order(self, form: str) -> list[int]:
        """Parts (0 prefix, 1 suffix, 2 middle) in the order of the output."""
        return [1, 0, 2] if form == "spm" else [0, 1, 2]


#: A part's place in the original text: prefix, middle, suffix.
ORIGINAL = (0, 2, 1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte places at which the units of a text end."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(data))


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def draw(plan: Plan, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    name = f"{plan.seed}:{'' if doc_id is None else doc_id}"
    return struct.unpack(">4I", hashlib.sha256(name.encode()).digest()[:16])


def cut(plan: Plan, doc_id: int | None, text: bytes):
    """``(n, form, ends, borders)``: the units' ends, and where prefix and middle end in bytes."""
    data = np.frombuffer(text, np.uint8)
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draw(plan, doc_id)
    if not n or any(m in text for m in plan.marks) or h3 % 100 >= plan.infill_percent:
        return n, "plain", ends, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    places = [int(ends[k - 1]) if k else 0 for k in (a, b)]
    return n, "spm" if h4 % 100 < plan.suffix_first_percent else "psm", ends, places


def _pieces(text: bytes, ends: np.ndarray, a: int, b: int) -> Iterator[bytes]:
    """text[a:b] in pieces of whole units; a unit beyond the bound is cut between code points."""
    while a < b:
        e = min(b, a + PIECE_BYTES)
        if e < b:
            k = int(np.searchsorted(ends, e, "right"))
            if k and ends[k - 1] > a:
                e = int(ends[k - 1])
            else:
                while text[e] & 0xC0 == 0x80:
                    e -= 1
        yield bytes(text[a:e])
        a = e


def _keyed_rows(split: int, rows: Iterator) -> Iterator[tuple[bytes, int | None, bytes]]:
    """Rows with their keys: content, input partition and number among equal rows there."""
    seen: Counter[bytes] = Counter()
    for doc_id, text in rows:
        text = bytes(text) if text is not None else b""
        what = hashlib.blake2b(f"{doc_id}\0".encode() + text, digest_size=12).digest()
        number = seen[what]
        seen[what] += 1
        yield what + struct.pack(">II", split, number), doc_id, text


def _emit(plan: Plan, packed):
    """Pieces by output place, after a header with what is known of the row."""
    def run(split: int, rows: Iterator):
        for key, doc_id, text in _keyed_rows(split, rows):
            n, form, ends, places = cut(plan, doc_id, text)
            if form == "plain":
                yield (key, HEADER), (doc_id, n, form, None, None)
                parts = [(0, len(text), None)]
            else:
                a, b = places
                data = np.frombuffer(text, np.uint8)
                yield (key, HEADER), (doc_id, n, form, _chars(data[:a]), _chars(data[a:b]))
                span = ((0, a), (b, len(text)), (a, b))
                parts = [(*span[p], plan.marks[p]) for p in plan.order(form)]
            at = 0
            for a, b, mark in parts:
                for piece in ([mark] if mark else []) + list(_pieces(text, ends, a, b)):
                    yield (key, at), packed(piece)
                    at += 1
    return run


class _Codec:
    """Pieces compressed for the shuffle; made anew in every worker."""

    def __init__(self):
        self._pack = self._open = None

    def __getstate__(self):
        return {}

    def __setstate__(self, state):
        self.__init__()

    def __call__(self, piece: bytes) -> bytes:
        if self._pack is None:
            self._pack = zstandard.ZstdCompressor(level=3)
        return self._pack.compress(piece)

    def open(self, piece: bytes) -> bytes:
        if self._open is None:
            self._open = zstandard.ZstdDecompressor()
        return self._open.decompress(piece)


def _sorted(pairs: RDD, partitions: int) -> RDD:
    return pairs.repartitionAndSortWithinPartitions(partitions, lambda key: zlib.crc32(key[0]))


def _partitions(docs: DataFrame, text: Column) -> int:
    """Enough for the text's bytes, so that a task's pieces fit the sorter's memory."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("size")).first()["size"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def _assembled(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> tuple[RDD, int]:
    """Rows' headers and pieces, sorted by row and output place."""
    text = docs[text_col].cast("string").cast("binary")
    n = _partitions(docs, text)
    rows = docs.select(docs[id_col].cast("long"), text).rdd
    return _sorted(rows.mapPartitionsWithIndex(_emit(plan, _Codec())), n), n


def _read_back(plan: Plan):
    """Digests of the outputs; their pieces again, by place in the original text."""
    def run(pairs: Iterator):
        codec, part_of = _Codec(), {mark: i for i, mark in enumerate(plan.marks)}
        key = header = output = None

        def done():
            digest = output.hexdigest()
            # a plain output is its text: read back in the order it has
            return (key, HEADER, 0), (*header, digest, digest if header[2] == "plain" else None)

        for (row, at), value in pairs:
            if at == HEADER:
                if key is not None:
                    yield done()
                key, header, output, part = row, value, hashlib.sha256(), None
                continue
            piece = codec.open(value)
            output.update(piece)
            if header[2] == "plain":
                continue
            if piece in part_of:
                part = part_of[piece]
            else:
                yield (row, ORIGINAL[part], at), value
        if key is not None:
            yield done()
    return run


def _restored(pairs: Iterator):
    codec, header, text = _Codec(), None, None

    def done():
        return (*header[:6], header[6] or text.hexdigest())

    for (_, at, _), value in pairs:
        if at == HEADER:
            if header is not None:
                yield done()
            header, text = value, hashlib.sha256()
        else:
            text.update(codec.open(value))
    if header is not None:
        yield done()


def infill_digests(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: units, form, lengths of prefix and middle in code points, SHA-256 of
    the output and of the text rebuilt from it."""
    pairs, n = _assembled(docs, plan, id_col, text_col)
    rows = _sorted(pairs.mapPartitions(_read_back(plan)), n).mapPartitions(_restored)
    return docs.sparkSession.createDataFrame(rows, DIGESTS, verifySchema=False)


def infill_texts(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The outputs themselves: ``(doc_id, form, output)``, one row per document."""
    def joined(pairs: Iterator):
        codec, header, parts = _Codec(), None, []
        for (_, at), value in pairs:
            if at == HEADER:
                if header is not None:
                    yield header[0], header[2], b"".join(parts).decode("utf-8", "replace")
                header, parts = value, []
            else:
                parts.append(codec.open(value))
        if header is not None:
            yield header[0], header[2], b"".join(parts).decode("utf-8", "replace")

    pairs, _ = _assembled(docs, plan, id_col, text_col)
    return docs.sparkSession.createDataFrame(pairs.mapPartitions(joined), "doc_id long, form string, output string",
                                             verifySchema=False)


def restored_text(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text behind an output, in Spark's own functions (for outputs that were stored)."""
    def between(a: str, b: str | None) -> Column:
        after = F.substring_index(output, a, -1)
        return F.substring_index(after, b, 1) if b else after

    p, s, m = plan.prefix, plan.suffix, plan.middle
    return (F.when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m)))
            .when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p)))
            .otherwise(output))
