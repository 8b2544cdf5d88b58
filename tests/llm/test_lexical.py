import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import lexical as X
from quire.llm.common import text_buffer
from tests.llm import edge

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    """Every document scored for every item, by the contract's formulas."""
    counts = [(i, Counter(cut(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms, scored = set(cut(text)), []
        for doc, c in counts:
            m = 100 - 50 + (50 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((s, doc))
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        out += [(item, k, doc, s) for k, (s, doc) in enumerate(scored[:top], 1)]
    return order(out)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbZ9é中\x7f\x80 .{_"), max_size=30), max_size=6), st.sampled_from([3, 8, 1000]))
def test_counts_equal_the_term_pattern(texts, window):
    terms = sorted({t.encode() for x in texts for t in cut(x)} - {b"a"}) or [b"zz"]
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    old, X.WINDOW = X.WINDOW, window
    try:
        size, doc, term, count = X.count_terms(X.Vocabulary.of(terms), len(terms), data, offsets)
    finally:
        X.WINDOW = old
    assert [X.terms_of(t) for t in texts] == [[w.encode() for w in cut(t)] for t in texts]
    assert list(size) == [len(cut(t)) for t in texts]
    got = Counter({(int(d), terms[t]): int(c) for d, t, c in zip(doc, term, count, strict=True)})
    assert got == Counter((i, w.encode()) for i, t in enumerate(texts) for w in cut(t) if w.encode() in terms)


def test_equal_hashes_are_told_apart_by_their_bytes():
    terms = [b"aa", b"bb", b"cc"]
    v = X.Vocabulary.of(terms)
    v.hashes[:] = 7
    data = np.frombuffer(b"ccxxaaBB", np.uint8)
    got = v.find(np.array([7, 7, 7, 7], np.uint64), data, np.array([0, 2, 4, 6]), np.array([2, 2, 2, 2]))
    assert [terms[i] if i >= 0 else None for i in got] == [b"cc", None, b"aa", b"bb"]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_buckets_lose_no_row_and_score_exactly(seed):
    rng = random.Random(seed)
    weights = np.array([rng.choice([1, 50, 900, 4000]) for _ in range(12)], np.int64)
    rows = []
    for i in range(rng.randint(1, 40)):
        terms = sorted(rng.sample(range(12), rng.randint(1, 8)))
        rows.append((i, rng.choice([i, 5, None]), terms, [rng.choice([3, 1000, 20000]) for _ in terms]))
    length = [math.sqrt(sum(int(weights[t]) * x * x for t, x in zip(r[2], r[3], strict=True))) for r in rows]
    bucket = X.Bucket(pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array(length),
         pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["row", "doc_id", "l", "t", "i"]))
    own = np.array(sorted(rng.sample(range(14), rng.randint(1, 8))), np.int64)
    own = own[own < 12]
    every = []
    for r in rows:
        s = sum(int(weights[t]) * x for t, x in zip(r[2], r[3], strict=True) if t in own)
        if s > 0:
            every.append((s, X.LAST_ID if r[1] is None else r[1], r[0]))
    every.sort(key=lambda e: (-e[0], e[1], e[2]))
    k = rng.randint(1, 6)
    least = every[k - 1] if len(every) >= k and rng.random() < 0.7 else None
    docs, score = bucket.search(X.Query(own, weights[own], least))
    got = sorted(zip(score.tolist(), bucket.ids[docs].tolist(), bucket.rows[docs].tolist(), strict=True), key=lambda e: (-e[0], e[1], e[2]))
    assert got == (every[:k] if least else every)


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("first_part", [10, 10**6])
def test_ranks_equal_brute_force(spark, monkeypatch, first_part):
    monkeypatch.setattr(X, "FIRST_PART", first_part)                 # 10: thresholds from several parts
    docs = corpus(600) + [(1000 + i, "w3 w9 w9 copies") for i in range(150)] + [(7, "w3 w9 w9 copies")] * 90
    items = [(i, t) for i, t in corpus(25, 8)] + [(90, "w3 w9 nothing"), (91, None), (92, "..."), (93, "unseen"), (90, "copies")]
    got = X.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                           spark.createDataFrame(items, "item_id long, text string"))
    assert order(map(tuple, got.collect())) == brute(docs, items)


def test_blocks_of_queries_give_the_same_rows(spark):
    docs, items = corpus(80), corpus(12, 5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert order(map(tuple, X.rank_documents(d, i, top=7, block_bytes=200).collect())) == brute(docs, items, 7)


def test_edges(spark):
    docs = edge.docs(spark)
    items = spark.createDataFrame([(1, "The HOUSE word17 中文", "x", 5), (None, "dog", "y", 6), (3, "", "z", 7)], "item_id long, text string, row string, score long")
    want = brute([(r[0], r[1]) for r in edge.rows()], [(1, "The HOUSE word17 中文"), (None, "dog"), (3, "")])
    assert want and order(map(tuple, X.rank_documents(docs, items).collect())) == want
    none = spark.createDataFrame([], items.schema)
    assert X.rank_documents(docs, none).count() == 0 and X.rank_documents(edge.empty(spark), items).count() == 0
