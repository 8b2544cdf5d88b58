"""Secret scans: base patterns, and a worklist that unwraps encoded layers until nothing new.

Each text starts a worklist of layers.  A layer is scanned with the base patterns; then it is
unwrapped: escapes (``%41``, ``\\u0041``, ``\\x41``, ``&#65;``) are decoded in place, and runs of
base64 (also wrapped over lines) that decode to text or to a compressed stream, and compressed
streams whose bytes are written as ``%41`` or ``\\x41`` among plain characters, become layers of their own.  New layers
join the worklist until no layer is new; a set of layer digests detects cycles (a stream that
decompresses to itself ends at once).  Every layer maps its characters to places of the
original text, so what is found in a layer is reported there: exactly for escapes, as the whole
encoded run for base64 and compressed data.  In a layer only findings that hold a decoded
character are reported, so base findings are never repeated.

One map over the scan: no shuffle, memory bounded by a batch, one text's layers and a window of
each decompressed stream on the way: streams are read to their end, over all their members, and a
long one is scanned in windows that end at white space and overlap.  ``complete`` is false for a
text with a stream that breaks off or is damaged after its start, has more than ``DEPTH`` nested
streams, or holds a run without white space longer than ``WINDOW`` (which is cut, with an overlap).

Defined cases: null text counts as empty and has no spans; every row is scanned alone, so
repeated rows get equal spans; an empty table gives no rows; other columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quire.llm.common import small_batches

KINDS = ("assign", "access", "hex")
#: Decompressed data is made in chunks, scanned whole up to ``BLOCK`` bytes and beyond in windows:
#: a stream built to swell without end must not take a worker's memory.
CHUNK, BLOCK, WINDOW, OVERLAP, DEPTH = 1 << 16, 1 << 20, 8 << 20, 4096, 100
MASK = "[SECRET]"

# The base patterns; the letters of the names in either case (ASCII only).
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_ESCAPES = re.compile(r"((?:%[0-9A-Fa-f]{2})+)"
                      r"|((?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+)"
                      r"|&#(?:[xX]0*([0-9A-Fa-f]{1,6})|0*([0-9]{1,7}));")
_UNICODE = re.compile(r"\\u\{?([0-9A-Fa-f]{4,6}|[0-9A-Fa-f]{1,6}(?=\}))\}?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
# The shortest base match, an assignment of 14 characters, takes 19 and one of padding.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
# Lines of a wrapped run.  The last one is optional: a run that fills its lines may end in a newline, and
# a pattern that matches there at once is not tried again from each of the run's lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)++(?:[A-Za-z0-9+/_-]++={0,2})?")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
# Bytes written as escapes beside characters that stay as they are.
_HIGH_URL, _HIGH_X = re.compile(r"%[0189A-Fa-f][0-9A-Fa-f]"), re.compile(r"\\x[0189A-Fa-f][0-9A-Fa-f]")
_URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()+/-])++")
_X_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[nrtabfv0\\'\"]|[ -\[\]-~])++")
_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\([nrtabfv0\\'\"])|(.)", re.DOTALL)
_SHORT_ESCAPES = dict(zip("nrtabfv0\\'\"", b"\n\r\t\a\b\f\v\0\\'\"", strict=True))
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
_URLSAFE = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost without overlap within a kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


@dataclass
class Layer:
    """A decoded text.  ``begin[i]`` and ``end[i]`` are the place in the original of character
    i (``None``: the original itself); ``decoded[i]`` says whether unwrapping made it."""

    text: str
    chain: str = ""
    begin: list[int] | None = None
    end: list[int] | None = None
    decoded: list[bool] | None = None
    part: bool = False

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begin is None else (self.begin[a], max(self.end[a:b]))

    def spans(self) -> Iterator[tuple[str, int, int, str]]:
        for kind, a, b in base_spans(self.text):
            if self.decoded is None or any(self.decoded[a:b]):
                yield (kind, *self.place(a, b), self.chain)

    def whole(self, text: str, chain: str, a: int, b: int, part: bool = False) -> Layer:
        """A layer all of whose characters stand for characters [a, b) of this one; ``part``: a
        window of a long stream."""
        begin, end = self.place(a, b)
        return Layer(text, f"{self.chain}.{chain}".lstrip("."), [begin] * len(text), [end] * len(text), [True] * len(text),
                     part)


class _Limit(Exception):
    """A caller's limit of decompressed bytes is reached."""


class _Budget:
    """Bytes that decompression may still make for one text (``None``: any), and whether all of
    the text's streams were read to their end."""

    def __init__(self, left: int | None = None):
        self.left, self.complete = left, True

    def take(self, data: bytes) -> bytes:
        if self.left is not None:
            self.left -= len(data)
            if self.left < 0:
                raise _Limit
        return data


def _format(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        return "zlib"
    if data[:3] == b"BZh":
        return "bzip2"
    if data[:6] == b"\xfd7zXZ\0":
        return "xz"
    return "zstd" if data[:4] == b"\x28\xb5\x2f\xfd" else None


_DECODERS = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor,
             "xz": lzma.LZMADecompressor}


class _Source:
    """Chunks as a file that zstandard can read."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data = chunks, b""

    def read(self, size: int) -> bytes:
        self.data = self.data or next(self.chunks, b"")
        out, self.data = self.data[:size], self.data[size:]
        return out


def _members(name: str, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What all members of a compressed stream decompress to, in chunks; EOFError if it breaks off."""
    if name == "zstd":
        reader = zstandard.ZstdDecompressor().stream_reader(_Source(chunks), read_across_frames=True)
        while out := reader.read(CHUNK):
            yield out
        return
    decoder, data = _DECODERS[name](), next(chunks, b"")
    while True:
        out = decoder.decompress(data, CHUNK)
        if out:
            yield out
        if decoder.eof:
            data = decoder.unused_data
            while len(data) < 6 and (more := next(chunks, b"")):
                data += more
            if name == "xz":
                data = data.lstrip(b"\0")
            if _format(data) != name:
                return
            decoder = _DECODERS[name]()
            continue
        data = getattr(decoder, "unconsumed_tail", b"")
        if not data and not out and getattr(decoder, "needs_input", True):
            data = next(chunks, b"")
            if not data:
                raise EOFError


def _decompress(name: str, chunks: Iterator[bytes], budget: _Budget) -> Iterator[bytes]:
    """The content of a stream as far as it can be read; a break after its start is reported."""
    begun = False
    try:
        for out in _members(name, chunks):
            begun = True
            yield budget.take(out)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        budget.complete &= not begun


def _readable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.95 * len(text)


def _windows(text: str, more: Iterator[str], budget: _Budget) -> Iterator[str]:
    """A long text in windows that end at white space and overlap."""
    while True:
        end = max(text.rfind(" "), text.rfind("\n"))
        if end <= OVERLAP and len(text) >= WINDOW:
            end, budget.complete = len(text), False
        if end > OVERLAP:
            yield text[:end]
            text = text[end - OVERLAP:]
        size = len(text) + BLOCK
        while len(text) < size:
            piece = next(more, None)
            if piece is None:
                yield text
                return
            text += piece


def _content(data: bytes | Iterator[bytes], budget: _Budget, chain: tuple = (), seen: frozenset = frozenset()
             ) -> Iterator[tuple[str, str, bool]]:
    """(chain, text, part) of decoded bytes: text as it is, or after all nested decompression; a
    long stream's text comes in parts."""
    chunks, first, ended = iter([data]) if isinstance(data, bytes) else data, [], False
    size = 0
    while size < BLOCK and not ended:
        piece = next(chunks, None)
        ended = piece is None
        first.append(piece or b"")
        size += len(first[-1])
    head = b"".join(first)
    whole = ended or isinstance(data, bytes)
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        text = decoder.decode(head, whole)
    except UnicodeDecodeError:
        text = ""
    if _readable(text):
        if whole:
            yield ".".join(chain), text, False
            return
        decoder.errors = "replace"                          # a long text is scanned past a damaged place
        rest = (decoder.decode(x) for x in chunks)
        for part in _windows(text, rest, budget):
            yield ".".join(chain), part, True
        return
    name, digest = _format(head), hashlib.sha256(head).digest()
    if name is None or whole and digest in seen:
        return
    if len(chain) >= DEPTH:
        budget.complete = False
        return
    yield from _content(_decompress(name, itertools.chain([head], chunks), budget), budget, (*chain, name), seen | {digest})


def _layers(layer: Layer, data: bytes, outer: str, a: int, b: int, budget: _Budget) -> Iterator[Layer]:
    """Layers of the bytes that characters [a, b) decode to."""
    try:
        for chain, text, part in _content(data, budget):
            yield layer.whole(text, f"{outer}.{chain}".rstrip("."), a, b, part)
    except _Limit:
        budget.complete = False
        budget.left = 0


def _char(code: int) -> str | None:
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _unescape(layer: Layer, budget: _Budget) -> Iterator[Layer]:
    """The layer with its escapes decoded in place."""
    t = layer.text
    if "%" not in t and "\\" not in t and "&#" not in t:
        return
    out, begin, end, made, last, names = [], [], [], [], 0, set()

    def copy(a: int, b: int) -> None:
        out.append(t[a:b])
        begin.extend(range(a, b) if layer.begin is None else layer.begin[a:b])
        end.extend(range(a + 1, b + 1) if layer.end is None else layer.end[a:b])
        made.extend([False] * (b - a) if layer.decoded is None else layer.decoded[a:b])

    def put(text: str, a: int, b: int, name: str) -> None:
        s, e = layer.place(a, b)
        out.append(text)
        begin.extend([s] * len(text))
        end.extend([e] * len(text))
        made.extend([True] * len(text))
        names.add(name)

    for m in _ESCAPES.finditer(t):
        copy(last, m.start())
        last = m.end()
        if m[1]:
            data = bytes.fromhex(m[1].replace("%", ""))
            at = m.start()
            while data:                                     # bytes that are not UTF-8 stay escaped
                try:
                    text, bad = data.decode("utf-8"), 0
                except UnicodeDecodeError as e:
                    text, bad = data[:e.start].decode("utf-8"), e.end - e.start
                for c in text:
                    width = 3 * len(c.encode("utf-8"))
                    put(c, at, at + width, "url")
                    at += width
                copy(at, at + 3 * bad)
                at += 3 * bad
                data = data[len(text.encode("utf-8")) + bad:]
        elif m[2]:
            pending = None                                  # a high surrogate waiting for its low one
            for u in _UNICODE.finditer(m[2]):
                a, b = m.start() + u.start(), m.start() + u.end()
                code = int(u[1] or u[2] or u[3], 16)
                if pending and 0xDC00 <= code < 0xE000:
                    put(chr(0x10000 + ((pending[0] - 0xD800) << 10) + code - 0xDC00), pending[1], b, "unicode")
                    pending = None
                    continue
                if pending:
                    copy(pending[1], pending[2])
                    pending = None
                if 0xD800 <= code < 0xDC00:
                    pending = (code, a, b)
                elif _char(code):
                    put(chr(code), a, b, "unicode")
                else:
                    copy(a, b)
            if pending:
                copy(pending[1], pending[2])
        else:
            c = _char(int(m[3], 16) if m[3] else int(m[4]))
            if c:
                put(c, *m.span(), "unicode")
            else:
                copy(*m.span())
    if names:
        copy(last, len(t))
        chain = "+".join(sorted(names))
        yield Layer("".join(out), f"{layer.chain}.{chain}".lstrip("."), begin, end, made)


def _consumed(data: bytes) -> int:
    """How many bytes of ``data`` its first compressed stream takes; all if that cannot be told."""
    name = _format(data)
    if name not in _DECODERS:
        return len(data)
    decoder, rest = _DECODERS[name](), data
    try:
        while not decoder.eof:
            out = decoder.decompress(rest, CHUNK)
            rest = getattr(decoder, "unconsumed_tail", b"")
            if not out and not rest and not decoder.eof:
                return len(data)
        return len(data) - len(decoder.unused_data)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return len(data)


def _escaped_bytes(layer: Layer, budget: _Budget) -> Iterator[Layer]:
    """Layers of compressed data in runs of escaped bytes and characters left as they are."""
    t = layer.text
    for high, runs, outer in ((_HIGH_URL, _URL_BYTES, "url"), (_HIGH_X, _X_BYTES, "unicode")):
        if not high.search(t):
            continue
        for m in runs.finditer(t):
            if not high.search(m[0]):
                continue
            data, places = bytearray(), []
            for u in _BYTE.finditer(m[0]):
                data.append(int(u[1] or u[2], 16) if u[1] or u[2] else _SHORT_ESCAPES[u[3]] if u[3] else ord(u[4]))
                places.append(m.start() + u.start())
            places.append(m.end())
            data, at = bytes(data), 0
            while magic := _MAGIC.search(data, at):
                at = magic.start()
                whole = budget.complete                     # a chance magic that is no stream says nothing
                begun = False
                size = _consumed(data[at:]) if budget.left is None else len(data) - at
                for new in _layers(layer, data[at:], outer, places[at], places[at + size], budget):
                    begun = True
                    yield new
                if not begun and budget.left is None:
                    budget.complete = whole
                at += size if begun else 1


def _decoded64(run: str) -> bytes | None:
    raw = run.rstrip("=").translate(_URLSAFE)
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _wrapped(lines: list[re.Match]) -> Iterator[list[re.Match]]:
    """Groups of lines that may be one wrapped run: all, and lines of one width with and without a
    shorter last one."""
    yield lines
    a = 0
    while a < len(lines):
        b = a + 1
        while b < len(lines) and len(lines[b][0]) == len(lines[a][0]):
            b += 1
        if b < len(lines) and len(lines[b][0]) < len(lines[a][0]) and (a, b + 1) != (0, len(lines)):
            yield lines[a:b + 1]
        if b - a > 1 and (a, b) != (0, len(lines)):
            yield lines[a:b]
        a = b


def _unbase64(layer: Layer, budget: _Budget) -> Iterator[Layer]:
    for m in _WRAPPED.finditer(layer.text) if "\n" in layer.text else ():
        run = list(_LINE.finditer(layer.text, *m.span()))
        for lines in _wrapped(run) if len(run) > 1 else ():  # one line is found below
            data = _decoded64("".join(x[0] for x in lines))
            if data:
                yield from _layers(layer, data, "base64", lines[0].start(), lines[-1].end(), budget)
    for m in _BASE64.finditer(layer.text):
        data = _decoded64(m[0])
        if data:
            yield from _layers(layer, data, "base64", *m.span(), budget)


def find_spans(text: str | None, max_decoded: int | None = None) -> list[tuple[str, int, int, str]]:
    """All (kind, start, end, chain) of a text, sorted by start and kind; chain is empty for
    base findings and names the unwrapped layers, outermost first, for the others.  With
    ``max_decoded`` compressed layers are left where all would decompress to more bytes."""
    return scan_text(text, max_decoded)[0]


def scan_text(text: str | None, max_decoded: int | None = None) -> tuple[list[tuple[str, int, int, str]], bool]:
    """The spans of a text, and whether all its streams were read to their end."""
    root, budget = Layer(text or ""), _Budget(max_decoded)
    seen: set[tuple[bytes, int, int]] = set()
    found: dict[tuple[str, int, int], str] = {}

    def walk(top: Layer) -> None:
        work = deque([top])
        while work:
            layer = work.popleft()
            for kind, a, b, chain in layer.spans():
                found.setdefault((kind, a, b), chain)
            for unwrap in (_unescape, _escaped_bytes, _unbase64):
                for new in unwrap(layer, budget):
                    if not new.text:
                        continue
                    key = (hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest(), *new.place(0, len(new.text)))
                    if key not in seen:
                        seen.add(key)
                        if new.part:
                            walk(new)                       # at once: only one window is held
                        else:
                            work.append(new)

    seen.add((hashlib.sha256(root.text.encode("utf-8", "surrogatepass")).digest(), 0, len(root.text)))
    walk(root)
    return sorted(((k, a, b, chain) for (k, a, b), chain in found.items()),
                  key=lambda x: (x[1], KINDS.index(x[0]), x[3] != "", x[2], x[3])), budget.complete


def redacted(text: str | None, mask: str = MASK) -> str | None:
    """The text with every span (overlapping ones as one) replaced by ``mask``."""
    spans = sorted((a, b) for _, a, b, _ in find_spans(text))
    if not spans:
        return text
    out, last = [], 0
    for a, b in spans:
        if a >= last:
            out += [text[last:a], mask]
        last = max(last, b)
    return "".join([*out, text[last:]])


SPAN_TYPE = "array<struct<kind: string, start: bigint, end: bigint, chain: string>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chain", pa.string())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id``, ``spans``, all findings with their layers, and ``complete``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "chain")
        for batch in batches:
            told = [scan_text(t) for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(names, s, strict=True)) for s in found] for found, _ in told]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS), pa.array([c for _, c in told], pa.bool_())],
                                             ["doc_id", "spans", "complete"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPAN_TYPE}, complete boolean")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with secrets in the text masked; ``length_col`` (where it exists) follows."""
    small_batches(docs.sparkSession)
    names = docs.columns
    text_at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, schema = list(batch.columns), batch.schema
            before = columns[text_at].to_pylist()
            after = [redacted(t) for t in before]
            columns[text_at] = pa.array(after, schema.field(text_at).type)
            if length_at is not None:
                lengths = [n if x == y else len(y) for n, x, y in zip(columns[length_at].to_pylist(), before, after, strict=True)]
                columns[length_at] = pa.array(lengths, schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, docs.schema)
