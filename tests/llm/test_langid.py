import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import langid as G, labels
from tests.llm import edge

WORDS = {"en": "the of and house water with from this that what there which".split(),
         "fr": "le de et maison eau avec être très où voilà chez garçon".split(),
         "de": "der und von haus wasser mit über straße für schön welche nicht".split()}


def plain_grams(text):
    """N-grams of one text, by Python's own strings."""
    norm = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower())
    raw = (" " + " ".join(norm.split(" ")) + " ").encode()
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return {r: [int.from_bytes(raw[i:i + r], "little") for i in range(len(raw) - r + 1)] for r in G.ORDERS}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZÉé ß中\n.9  "), max_size=30), max_size=6))
def test_grams_equal_python_strings(texts):
    data, offsets = G.normalise(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        for order in G.ORDERS:
            a, b = (x[i] for x in G._starts(offsets, order))
            assert list(G.grams(data, a, b, order)) == plain_grams(t)[order]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abc é", max_size=25), min_size=1, max_size=6), st.integers(1, 70))
def test_masks_hold_every_language_and_counts_equal_single_look_ups(texts, n_langs):
    rng = random.Random(n_langs)
    every = sorted({g for t in texts for v in plain_grams(t).values() for g in v})
    has = [(lang, g) for g in every for lang in range(n_langs) if rng.random() < 0.4]
    f = G.build_filters([f"l{i:02}" for i in range(n_langs)], np.array([x for x, _ in has], np.int64), np.array([g for _, g in has], np.uint64))
    rows = [r for r in G.rows_of(np.array(every, np.uint64))]

    def member(lang, k):
        return all(f.table[lang // 64][r[k]] >> np.uint64(lang % 64) & np.uint64(1) for r in rows)

    assert all(member(lang, every.index(g)) for lang, g in has)                      # no false negatives
    hits, total = G.language_counts(f, *G.normalise(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        own = [g for v in plain_grams(t).values() for g in v]
        assert total[i] == len(own)
        assert list(hits[i]) == [sum(member(lang, every.index(g)) for g in own) for lang in range(n_langs)]


def test_blocks_give_the_same_counts(monkeypatch):
    texts = [" ".join(random.Random(i).choices(WORDS["fr"], k=i)) for i in range(40)]
    found = np.array(sorted({g for v in plain_grams(texts[-1]).values() for g in v}), np.uint64)
    f = G.build_filters(["a", "b"], np.arange(len(found)) % 2, found)
    data, offsets = G.normalise(pa.array(texts, pa.string()))
    whole = G.language_counts(f, data, offsets)
    monkeypatch.setattr(G, "BLOCK", 7)
    blocked = G.language_counts(f, data, offsets)
    assert (whole[0] == blocked[0]).all() and (whole[1] == blocked[1]).all()


def test_correction_takes_the_chance_hits_off():
    f = G.Filters(["full", "thin"], np.zeros((1, 1), np.uint64))
    best, share = G.decide(f, np.array([0.5, 0.0]), np.array([[60, 40], [50, 0]]), np.array([100, 100]))
    assert list(best) == [1, 0] and list(share) == [0.4, 0.0]                        # 60 hits of 100 at 1/2 are 20


def corpus(spark, n=600):
    rng, rows = random.Random(5), []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", "de"])
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 30))), lang))
    return rows


def test_learnt_n_grams_equal_counts_by_hand(spark):
    rows = corpus(spark, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = G.learn(docs, F.col("doc_id") % 2 == 0, gram_share=0.004)
    counts = {}
    for i, text, lang in rows:
        for order, own in plain_grams(text).items():
            if i % 2 == 0:
                counts.setdefault((lang, order), Counter()).update(own)
    freq = Counter(r[2] for r in rows if r[0] % 2 == 0)
    assert got.languages == sorted(freq, key=lambda x: (-freq[x], x))
    kept = [(got.languages.index(lang), g) for (lang, _), c in counts.items() for g, n in c.items() if n >= 2 and n >= 0.004 * c.total()]
    want = G.build_filters(got.languages, np.array([x for x, _ in kept]), np.array([g for _, g in kept], np.uint64))
    assert (got.table == want.table).all()


def test_held_out_accuracy_and_sample_bound(spark):
    docs = spark.createDataFrame(corpus(spark), "doc_id long, text string, lang string").repartition(3)
    held = labels.fold(F.col("doc_id"), 4) == 2
    for size in (4000, 60):                                                          # 60: every language sampled
        out = G.identify(docs, G.learn(docs, ~held, sample_docs=size)).join(docs.filter(held), "doc_id").collect()
        assert len(out) > 100 and sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.98
        assert all(0 <= r["score"] <= 1 for r in out)


def test_answers_don_t_depend_on_held_out_labels(spark):
    rows = corpus(spark, 200)
    held = labels.fold(F.col("doc_id"), 4) == 2
    schema = "doc_id long, text string, lang string"
    out = [sorted(map(tuple, G.identify_languages(docs, ~held).collect())) for docs in (
        spark.createDataFrame(rows, schema),
        spark.createDataFrame(rows, schema).withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))))]
    assert out[0] == out[1]


def test_edges(spark):
    docs = edge.docs(spark)
    out = G.identify_languages(docs, F.lit(True))
    assert edge.ids(out) == edge.all_ids()
    texts = {r[0]: r[1] for r in edge.rows()}
    for r in out.collect():
        text = texts.get(r["doc_id"]) if r["doc_id"] is not None else "x"
        lettered = any(unicodedata.category(c).startswith("L") for c in text or "")
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not lettered)
            assert r["lang_pred"] in ("en", "und")
    assert G.identify_languages(edge.empty(spark), F.lit(True)).count() == 0
    none = G.identify(docs, G.learn(docs, F.lit(False)))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}


def test_unknown_text_takes_the_most_frequent_language(spark):
    docs = spark.createDataFrame([(1, "aaa bbb", "b"), (2, "aaa bbb", "b"), (3, "ccc ddd", "a"), (4, "ccc ddd", "a")],
                                 "doc_id long, text string, lang string")
    f = G.learn(docs, F.lit(True))
    assert f.languages == ["a", "b"]
    probe = spark.createDataFrame([(1, "zzz"), (2, "12 !"), (3, "bbb")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in G.identify(probe, f).collect()}
    assert got[1] == ("a", 0.0) and got[2] == ("und", 0.0) and got[3][0] == "b" and got[3][1] > 0
