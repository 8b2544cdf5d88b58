import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing as P
from tests.llm import edge

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_ids_equal_tokenizers(texts):
    encode = P.encoder(RANKS, PATTERN)
    assert [encode(t) for t in texts] == reference_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(1, 5))
def test_best_fit_keeps_its_bounds(lengths, bound):
    fit, fill, open_now = P.BestFit(40, bound), {}, 0
    for n in lengths:
        chosen, offset = fit.place(n)
        assert fill.get(chosen, 0) == offset                        # gapless from 0
        fill[chosen] = offset + n
        assert fill[chosen] <= 40 and fit.n_open <= bound
        assert fit.bits == sum(1 << f for f, bins in enumerate(fit.by_free) if bins)


def test_tightest_bin_is_taken_and_fullest_closes():
    fit = P.BestFit(10, 2)
    assert [fit.place(n)[0] for n in (6, 8)] == [0, 1]
    assert fit.place(2) == (1, 8)                                    # 2 free is tighter than 4
    assert fit.place(7)[0] == 2
    assert fit.place(9)[0] == 3                                      # bin 2, the fullest, has closed
    assert fit.place(3) == (0, 6)


def test_pieces():
    assert P.pieces(10, 10) == [(0, 10)] and P.pieces(25, 10) == [(0, 5), (5, 10), (15, 10)] and P.pieces(20, 10) == [(0, 10), (10, 10)]


def test_round_trip(spark):
    rows = edge.rows()
    out = [r.asDict() for r in P.pack_documents(edge.docs(spark), RANKS, PATTERN).collect()]
    texts = {r[0]: r[1] or "" for r in rows}
    ids = dict(zip(texts, [i + [0] for i in reference_ids(list(texts.values()))], strict=True))
    for doc_id in (1, 2, 4, 7, 9):
        own = sorted((r for r in out if r["doc_id"] == doc_id), key=lambda r: (r["piece"], r["sequence_id"], r["offset"]))
        for r in own:
            part = np.array(ids[doc_id][r["start"]:r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in own) == len(ids[doc_id]) * sum(1 for x in rows if x[0] == doc_id)
        assert [r["length"] for r in own if r["piece"]] == [2048] * max(0, len(own) - sum(r["piece"] == 0 for r in own))
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.pack_documents(edge.empty(spark), RANKS, PATTERN).count() == 0


def test_added_tokens_in_a_text_equal_tokenizers_by_default():
    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = P.encoder(RANKS, PATTERN)
    assert P.ADDED == {t.content: i for i, t in default.get_added_tokens_decoder().items()}
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny  z", "<|endoftext|", " 's<|endoftext|>'s  "):
        assert encode(text) == default.encode(text, add_special_tokens=False).ids
