import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import neardup as N
from quire.llm.components import components
from tests.llm import edge


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


words = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=400, deadline=None)
@given(words, words, st.integers(0, 12))
def test_banded_distance_is_exact_in_its_band(a, b, limit):
    assert N.banded_distance(a, b, limit) == min(edit_distance(a, b), limit + 1)


def test_sketch_keeps_order_and_occurrences():
    a = [f"w{i}" for i in range(300)]
    half = a[150:] + a[:150]
    same = lambda x, y: np.mean(N.order_minhash(N.labelled_kmers(x)) == N.order_minhash(N.labelled_kmers(y)))
    assert same(a, list(a)) == 1 and 0.2 < same(a, half) < 0.8        # order: half of the picked pairs turn round
    assert same(["x"] * 30, ["x"] * 60) < 0.9                        # occurrences: more of the same is not the same
    long = [f"w{i}" for i in range(20000)]
    assert len(N.order_minhash(N.labelled_kmers(long))) == N.SKETCHES


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_equal_union_find(spark, links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for x, y in links:
        if x != y:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def fixture():
    """Clusters of near copies, a large one, chains, and many texts that share one passage."""
    r = random.Random(3)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    edit = lambda w, p: [f"e{r.randrange(9999)}" if r.random() < p else x for x in w]
    out, passage = [], text(30)
    for size in (2, 3, 9, 30):
        base = text(200)
        out += [base, *(edit(base, 0.05) for _ in range(size - 1))]
    chain = text(200)
    for _ in range(4):
        chain = edit(chain, 0.12)
        out.append(chain)
    out += [passage + text(12) for _ in range(40)] + [text(100) for _ in range(40)] + [["solo"], ["solo", "two"], []]
    texts = [" ".join(x) for x in out]
    return texts + texts[:5] + [texts[0]] * 20


def brute_classes(texts, similarity=N.SIMILARITY):
    lists = [t.lower().split() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            n = max(len(lists[i]), len(lists[j]))
            near = texts[i] == texts[j] or (
                n and N.banded_distance(lists[i], lists[j], int((1 - similarity) * n + 1e-9)) <= int((1 - similarity) * n + 1e-9))
            if near and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_classes_equal_all_pairs(spark):
    texts = fixture()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small, levels in ((6, 3), (3, 2), (2, 1)):
        got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df, small=small, levels=levels).collect()}
        assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = sorted(r["doc_id"] for r in N.drop_near_duplicates(df).collect())
    assert kept == sorted(set(brute_classes(texts)))


def linked_outside():
    """Texts under one pivot in a large bucket: an unlike pivot, near copies apart from it, and a text
    whose only neighbour is inside by a chain."""
    r = random.Random(11)
    text = lambda n: [f"v{r.randrange(10 ** 6)}" for _ in range(n)]
    out, passage = [], text(40)
    out += [passage + text(60) for _ in range(12)]
    for _ in range(8):                                       # pairs of near copies, edited wherever only they agree
        own = text(60)
        out += [passage + own, passage + [w if i % 3 else f"x{r.randrange(10 ** 6)}" for i, w in enumerate(own)]]
    chain = passage + text(60)
    for i in range(6):
        chain = chain[:40 + 9 * i] + text(15) + chain[55 + 9 * i:]
        out.append(chain)
    return [" ".join(x) for x in out]


def test_links_of_texts_outside_the_pivots_class(spark):
    texts = linked_outside()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts)
    assert len(set(want)) < len(texts) - 8
    for small, levels in ((6, 3), (2, 1), (1, 3)):
        got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df, small=small, levels=levels).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_edge_rows(spark):
    out = N.near_duplicates(edge.docs(spark))
    assert edge.ids(out) == edge.all_ids()
    by = {r["doc_id"]: r["class_id"] for r in out.collect() if r["doc_id"] is not None}
    assert by[2] == by[1] == 1 and by[4] == by[3] == 3 and by[8] == by[7] == 7 and by[9] == 9
    kept = N.drop_near_duplicates(edge.docs(spark))
    assert kept.columns == edge.docs(spark).columns
    assert edge.ids(kept) == [None, None, 1, 3, 5, 6, 7, 9, 10]
    assert N.near_duplicates(edge.empty(spark)).count() == 0 and N.drop_near_duplicates(edge.empty(spark)).count() == 0


def seen(monkeypatch, name, at):
    """Rows of the tables that a step is called with."""
    counts, step = [], getattr(N, name)

    def run(*args):
        counts.append(args[at].count())
        return step(*args)
    monkeypatch.setattr(N, name, run)
    return counts


def test_a_group_of_near_copies_is_compared_with_one_pivot_a_text(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"e{r.randrange(9999)}" if r.random() < 0.05 else w for w in base) for _ in range(80)]
    compared = seen(monkeypatch, "_compare", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = 2                                                # so few buckets are compared pair by pair
    assert {x["class_id"] for x in N.near_duplicates(df, small=small).collect()} == {0}
    assert sum(compared) <= 3 * len(texts)


def test_words_that_unlike_texts_share_make_no_blocks(spark, monkeypatch):
    r = random.Random(7)
    text = lambda n: [f"w{r.randrange(1500)}" for _ in range(n)]
    passage = text(40)
    texts = [" ".join(passage + text(100)) for _ in range(80)]
    texts.append(" ".join([*texts[3].split()[:-9], *text(9)]))
    rows = seen(monkeypatch, "_across_classes", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x["class_id"] for x in N.near_duplicates(df).orderBy("doc_id").collect()] == [*range(80), 3] == brute_classes(texts)
    assert sum(rows) <= 5 * len(texts)


def test_texts_of_large_blocks_are_dealt_by_words(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 8)
    calls = seen(monkeypatch, "_profiles", 0)
    texts = fixture()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(df, small=3).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    assert len(calls) == 2


def test_texts_that_share_a_long_passage_take_few_rows_of_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 8)
    r = random.Random(13)
    passage = [f"p{i}" for i in range(60)]
    own = lambda n: [f"o{r.randrange(10 ** 6)}" for _ in range(n)]
    texts = [" ".join([*own(n), *passage]) for n in (10, 12, 13, 14) * 5 + (22, 25, 30) * 10]
    texts.append(" ".join([*texts[25].split()[:-6], *own(6)]))
    rows = seen(monkeypatch, "_across_classes", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts)
    assert want.count(0) == 20 and want[-1] == 25
    got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(rows) <= 4 * len(texts)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2 ** 32), st.sampled_from([0.8, 0.85, 0.9]), st.sampled_from([4, 5, 9, 30, 150]))
def test_linked_texts_share_a_block(seed, similarity, n):
    r = random.Random(seed)
    a = [f"w{r.randrange(n)}" for _ in range(n)]
    b = list(a)
    for _ in range(r.randrange(n // 2 + 1)):
        at = r.randrange(len(b) + 1)
        b[at:at + r.randrange(2)] = ["x"] * r.randrange(2)
    longer = max(len(a), len(b))
    linked = edit_distance(a, b) <= int((1 - similarity) * longer + 1e-9)
    assert N.is_linked(a, b, similarity) == linked
    k = N.gram(similarity)
    keys = [set(np.sort(N.labelled_kmers(x, k))[:int(k * (1 - similarity) * len(x) + 1e-9) + 1]) for x in (a, b)]
    assert k == 2 and (not linked or keys[0] & keys[1])


def test_long_alignments_stop_only_where_no_link_is_left():
    r = random.Random(2)
    for share in (0.02, 0.18, 0.22, 0.5):
        a = [f"w{r.randrange(50)}" for _ in range(400)]
        b = [f"x{i}" if r.random() < share else w for i, w in enumerate(a)][r.randrange(20):]
        for limit in (10, 80, 160):
            assert N.banded_distance(a, b, limit) == min(edit_distance(a, b), limit + 1)
