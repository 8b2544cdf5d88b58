"""The pipeline held against a plain Python version of every stage, and its queries' columns."""
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from quire.llm import mixing, packing, rules, secrets
from quire.llm.common import read_table
from quire.llm.queries import QUERIES
from tests.llm import edge
from tests.llm.test_mixing import brute_rake, tempered
from tests.llm.test_neardup import brute_classes
from tests.llm.test_packing import reference_ids
from tests.llm.test_rules import NAMES, brute

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = C.quality_rules(spark, docs, SF)
    judged = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for doc_id, text in plain.items():
        assert tuple(judged[doc_id][n] for n in NAMES) == brute(text)
    good = sorted(i for i in plain if judged[i]["kept"])
    assert sorted(r["doc_id"] for r in kept.collect()) == good and kept.columns == docs.columns
    classes = dict(zip(good, brute_classes([plain[i] for i in good]), strict=True))
    one = C.near_duplicates(spark, kept, SF)
    want = sorted(i for k, i in enumerate(good) if classes[i] == k)
    assert sorted(r["doc_id"] for r in one.collect()) == want and one.columns == docs.columns
    clean = C.secret_scan(spark, one, SF)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts == {i: secrets.redacted(plain[i]) for i in want} and clean.columns == docs.columns
    assert not any(secrets.base_spans(t) for t in texts.values())
    mixed = C.source_mixing(spark, clean, SF)
    weights = mixing.mix_weights(clean).collect()
    cells = Counter()
    for r in weights:
        cells[r["source"], r["lang"], r["topic"]] += len(texts[r["doc_id"]].split())
    raked = brute_rake(cells, [tempered(cells, a) for a in range(3)])
    for r in weights:
        assert r["weight"] == pytest.approx(raked[r["source"], r["lang"], r["topic"]] * sum(cells.values()), rel=1e-5)
    chosen = sorted(r["doc_id"] for r in weights if int(hashlib.md5(f"mix|{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52) < r["probability"])
    assert sorted(r["doc_id"] for r in mixed.collect()) == chosen and mixed.columns == docs.columns
    ids = dict(zip(chosen, (i + [0] for i in reference_ids([texts[i] for i in chosen])), strict=True))
    rows = C.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(
        (i, k, s, n, zlib.crc32(np.array(own[s:s + n], "<u4").tobytes())) for i, own in ids.items()
        for k, (s, n) in enumerate(packing.pieces(len(own), 2048)))


def test_edge_rows_pass_all_stages(spark):
    for docs in (edge.docs(spark), edge.empty(spark)):
        now = docs
        for name, stage in C.STAGES:
            now = stage(spark, now, SF)
            if name != "best_fit_packing":
                assert now.columns == docs.columns
        now.collect()


def test_registered(spark):
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mixing", "best_fit_packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
