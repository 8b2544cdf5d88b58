import hashlib
import random
from collections import Counter

import numpy as np

from quire.llm import fingerprint as P
from tests.llm import edge


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_levels_equal_brute_force():
    data = np.random.default_rng(0).integers(97, 112, 900).astype(np.uint8)
    want = [(P._MOST - sum(int(P._G[c]) for c in Counter(data[i:i + P.WINDOW].tolist()).values())) * (P.LEVELS - 1) // P._MOST
            for i in range(len(data) - P.WINDOW + 1)]
    assert list(P.entropy_levels(data, block=101)) == want and list(P.entropy_levels(data)) == want


def test_digest_does_not_depend_on_its_batch():
    r = random.Random(1)
    texts = ["", "ab", prose(r, 5), prose(r, 400), prose(r, 3000), "ab", "a" * 500, "é" * 20]
    ranks = P.rarity_ranks(np.arange(P.LEVELS))
    own = [P.digests([t], ranks)[0] for t in texts]
    assert [d.text() for d in P.digests(texts, ranks)] == [d.text() for d in own]
    assert own[0].n == 0 and own[1].n == 1 and own[1].text() == own[5].text() and len(own[4].bits) > 1
    assert [P.likeness(d, d) for d in own] == [1.0] * len(own)
    assert P.likeness(own[0], own[3]) == 0 and P.likeness(own[3], own[4]) < 0.2


def test_texts_of_few_characters_are_told_apart():
    ranks = P.rarity_ranks(np.arange(P.LEVELS))
    texts = ["a" * 500, "b" * 5000, "a" * 499, "", "x" * 31, "x" * 32, "=-" * 200, prose(random.Random(4), 80) + "a" * 500]
    own = P.digests(texts, ranks)
    assert all(d.n > 0 for d, t in zip(own, texts, strict=True) if t)
    like = [[P.likeness(a, b) for b in own] for a in own]
    assert like[0][1] == like[0][3] == like[1][2] == like[0][6] == 0 and like[0][2] == 1 and like[0][7] < 0.1
    # a text with other windows keeps to these
    assert P.digests([texts[7]], ranks)[0].text() == own[7].text() and own[7].n > 5


def test_likeness_follows_shared_text():
    r = random.Random(2)
    ranks = P.rarity_ranks(np.arange(P.LEVELS))
    for n in (100, 2000):
        text, other = prose(r, n), prose(r, n)
        scores = [P.likeness(*P.digests([text, text[:int(len(text) * p)] + other[:int(len(text) * (1 - p))]], ranks)) for p in (0, .25, .5, .75, 1)]
        assert scores == sorted(scores) and scores[0] < 0.15 and scores[2] > 0.25 and scores[4] == 1


def brute(rows, ranks):
    """All pairs of neighbours in one list: (id, digest of the edited text, likenesses)."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    texts = [t or "" for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        nxt = texts[(i + 1) % len(rows)]
        half = len(texts[i]) // 2
        changed = texts[i][:len(texts[i]) - half] + nxt[:half]
        a, b, c = P.digests([texts[i], changed, nxt], ranks)
        out.append((doc_id, len(texts[i]), hashlib.sha256(changed.encode()).hexdigest(), a.text(), b.text(), P.likeness(a, b), P.likeness(a, c)))
    return out


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_IN_RANGE", 7)
    r = random.Random(3)
    rows = [(i * 3, prose(r, r.randint(0, 120))) for i in range(60)] + [(None, "null id first " + prose(r, 30))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ranks = P.rarity_ranks(P.level_counts(df))
    got = [tuple(x)[:7] for x in P.fingerprint_documents(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, ranks), key=str)
    one = P.fingerprint_documents(df.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_edge_rows(spark):
    out = P.fingerprint_documents(edge.docs(spark))
    assert edge.ids(out) == edge.all_ids()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[4]["n_chars"] == 0 and by[4]["fingerprint"] == "" and by[1]["fingerprint"] == by[2]["fingerprint"]
    assert P.fingerprint_documents(edge.empty(spark)).count() == 0
