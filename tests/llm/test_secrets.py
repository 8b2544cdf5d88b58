import base64
import bz2
import gzip
import lzma
import os
import urllib.parse
import zlib

import pytest
import zstandard

from quire.llm import secrets as S
from tests.llm import edge

PLAIN = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def test_base_patterns():
    text = 'é Password: short, api_key="abcd1234" AKIA1234567890ABCD AKIAshort ' + "0f" * 16 + " " + "0f" * 15
    got = {(k, text[a:b]) for k, a, b in S.base_spans(text)}
    assert got == {("assign", 'api_key="abcd1234'), ("access", "AKIA1234567890ABCD"), ("hex", "0f" * 16)}


@pytest.mark.parametrize("wrap, chain", [
    (lambda b: base64.b64encode(b).decode(), "base64"),
    (lambda b: base64.urlsafe_b64encode(gzip.compress(b)).decode(), "base64.gzip"),
    (lambda b: base64.b64encode(zlib.compress(bz2.compress(b))).decode(), "base64.zlib.bzip2"),
    (lambda b: urllib.parse.quote(base64.b64encode(base64.b64encode(b)).decode().replace("=", "=")).replace("a", "%61"), "url.base64.base64"),
])
def test_nested_layers_map_to_the_encoded_run(wrap, chain):
    coded = wrap(PLAIN.encode())
    text = f"see {coded} here"
    found = [(k, text[a:b]) for k, a, b, c in S.find_spans(text) if c == chain]
    assert ("assign", coded) in found or ("assign", coded.rstrip("=")) in found


def test_escapes_map_exactly():
    text = "é pass\\u0077ord: abc\\x64efgh1 tail %41KIAABCDEFGHIJKLMNOP &#x41;KIAABCDEFGHIJKLMNOQ"
    found = {(k, text[a:b], c) for k, a, b, c in S.find_spans(text)}
    assert ("assign", "pass\\u0077ord: abc\\x64efgh1", "unicode+url") in found
    assert ("access", "%41KIAABCDEFGHIJKLMNOP", "unicode+url") in found
    assert ("access", "&#x41;KIAABCDEFGHIJKLMNOQ", "unicode+url") in found


def test_fixpoint_on_deep_and_repeating_layers():
    deep = PLAIN.encode()
    for _ in range(12):
        deep = base64.b64encode(zlib.compress(deep))
    assert any(c.count("base64") == 12 for *_, c in S.find_spans(deep.decode()))
    again = base64.b64encode(b"the same again and again" * 3).decode()
    assert S.find_spans(f"{again} {again}") == []
    bomb = base64.b64encode(zlib.compress(b"a" * (1 << 22))).decode()
    assert S.find_spans(bomb, max_decoded=1 << 12) == []


def test_streams_are_read_to_their_end():
    words = b"long and dull words " * (1 << 18)                          # 5 MB, several windows
    late = base64.b64encode(PLAIN.encode()).decode()
    for pack in (gzip.compress, bz2.compress, lzma.compress, lambda b: zstandard.ZstdCompressor().compress(b)):
        stream = base64.b64encode(pack(words) + pack(b" " + PLAIN.encode())).decode()
        text = f"{stream} then {late}"
        spans, complete = S.scan_text(text)
        assert complete and {text[a:b] for _, a, b, _ in spans} >= {stream.rstrip("="), late.rstrip("=")} or {
            text[a:b] for _, a, b, _ in spans} >= {stream, late}
    # a limit that the first stream reaches leaves plain base64 alone, and is told
    bomb = base64.b64encode(gzip.compress(words)).decode()
    spans, complete = S.scan_text(f"{bomb} {late}", max_decoded=1 << 12)
    assert not complete and any(c == "base64" for *_, c in spans)
    cut = base64.b64encode(gzip.compress(PLAIN.encode() + os.urandom(99).hex().encode())[:-20]).decode()
    spans, complete = S.scan_text(cut)
    assert not complete and spans


@pytest.mark.parametrize("coded", [
    base64.encodebytes(b"some words before that fill a line of base64 " + PLAIN.encode()).decode().strip(),
    base64.encodebytes(gzip.compress((PLAIN + "".join(map(str, range(99)))).encode())).decode().strip().replace("\n", "\r\n"),
    "dG9rZW49MTIzNDU2Nzg=",
    urllib.parse.quote(gzip.compress(PLAIN.encode())),
    urllib.parse.quote(zlib.compress(PLAIN.encode())),
    repr(zlib.compress(PLAIN.encode()))[2:-1],
    repr(gzip.compress(PLAIN.encode()))[2:-1],
])
def test_wrapped_short_and_mixed_runs(coded):
    text = f"see: {coded} here\nand there"
    found = [(text[a:b], chain) for k, a, b, chain in S.find_spans(text) if k == "assign"]
    assert any(run in (coded, coded.rstrip("=")) and chain for run, chain in found)


@pytest.mark.parametrize("tail", ["", "\n", "\r\n", "\n\n", "\nplain words follow", "\n  indented"])
@pytest.mark.parametrize("pad", [0, 1, 2])
def test_wrapped_runs_end_in_any_way(pad, tail):
    """Also a run without padding whose last line is full and ends in a newline."""
    body = ("filler " * 30).encode()
    body = body[:57 * 3 - len(PLAIN) - 20] + PLAIN.encode()
    body += b"." * (-len(body) % 57 + 57 - (pad and 3 - pad))          # whole lines, or 1 or 2 characters of padding
    coded = base64.encodebytes(body).decode().rstrip("\n")
    text = f"see\n{coded}{tail}"
    assert ("assign", coded.rstrip("=")) in {(k, text[a:b].rstrip("=")) for k, a, b, c in S.find_spans(text) if c == "base64"}


def test_time_on_wrapped_runs_is_linear():
    import random
    import time

    def seconds(n):
        text = base64.encodebytes(random.Random(n).randbytes(57 * n)).decode()
        t = time.process_time()
        S.find_spans(text)
        return time.process_time() - t

    seconds(100)
    assert seconds(16_000) < 8 * max(seconds(4_000), 0.05)


def test_a_byte_that_is_not_utf8_leaves_the_rest_of_its_run():
    text = "%FF" + "".join(f"%{b:02X}" for b in b"token=12345678")
    assert ("assign", 3, len(text), "url") in S.find_spans(text)


def test_redaction_masks_each_run_once():
    coded = base64.b64encode(PLAIN.encode()).decode()
    assert S.redacted(f"a {coded} b {PLAIN} c") == "a [SECRET] b [SECRET]\" c"
    assert S.redacted(None) is None and S.redacted("") == ""


def test_edge_rows(spark):
    out = S.scan(edge.docs(spark))
    assert edge.ids(out) == edge.all_ids()
    assert {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in out.collect()}[10] == ["assign"]
    kept = S.redact(edge.docs(spark))
    assert kept.columns == edge.docs(spark).columns and edge.ids(kept) == edge.all_ids()
    assert [r["text"][:8] for r in kept.filter("doc_id = 10").collect()] == ["[SECRET]"]
    assert S.scan(edge.empty(spark)).count() == 0 and S.redact(edge.empty(spark)).count() == 0
