import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import infill as I
from tests.llm import edge

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(doc_id, text):
    """The rules read off the contract, one text at a time."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexa = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(hexa[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text)), out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \t\n\x0b\x1c\x85\xa0é中😀<P>SM"), max_size=40), st.integers(0, 50))
def test_cut_equals_the_unit_pattern(text, doc_id):
    raw = text.encode()
    n, form, ends, places = I.cut(I.Plan(), doc_id, raw)
    want, out = brute(doc_id, text)
    assert (n, form) == want[1:3]
    assert [len(u.encode()) for u in UNIT.findall(text)] == [*map(int, I.np.diff(ends, prepend=0))]
    if places:
        assert len(raw[:places[0]].decode()) == want[3] and len(raw[places[0]:places[1]].decode()) == want[4]


@pytest.mark.parametrize("bound", [1 << 17, 7])
def test_digests_and_outputs_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(I, "PIECE_BYTES", bound)                     # 7: many pieces, units cut in code points
    rows = edge.rows() if bound > 100 else [r for r in edge.rows() if r[0] not in (7, 8)]
    rows += [(i, f"word{i} été 中文中文中文中文 <S {i}>\n tail  " * (i % 5), *edge.rows()[0][2:]) for i in range(100, 160)]
    rows += [(200, "has <M> inside", *rows[0][2:]), (201, "\t \n", *rows[0][2:]), (202, "x" * 50, *rows[0][2:])]
    docs = spark.createDataFrame(rows, edge.SCHEMA).repartition(5)
    want = [brute(r[0], r[1]) for r in rows]
    assert order(tuple(r) for r in I.infill_digests(docs).collect()) == order(w for w, _ in want)
    outputs = I.infill_texts(docs)
    assert order(tuple(r) for r in outputs.collect()) == order((w[0], w[2], o) for w, o in want)
    back = outputs.select("doc_id", I.restored_text(F.col("output"), F.col("form"))).collect()
    assert order(tuple(r) for r in back) == order((r[0], r[1] or "") for r in rows)


def test_forms_all_occur_and_empty_table(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    forms = {r["form"]: r["count"] for r in I.infill_digests(docs).groupBy("form").count().collect()}
    assert 160 < forms["plain"] < 240 and forms["spm"] > forms["psm"] > 10
    assert I.infill_digests(edge.empty(spark)).count() == 0 and I.infill_texts(edge.empty(spark)).count() == 0


def test_copies_under_one_id_are_dealt_over_partitions(spark):
    docs = spark.range(2000, numPartitions=4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    pairs, n = I._assembled(docs, I.Plan(), "doc_id", "text")
    sizes = pairs.glom().map(len).collect()
    assert len(sizes) == n and min(sizes) > 0.5 * max(sizes)
    assert I.infill_digests(docs).distinct().count() == 1 and I.infill_digests(docs).count() == 2000


def test_other_marks_and_shares(spark):
    plan = I.Plan(seed=7, infill_percent=100, suffix_first_percent=0, prefix="[pre]", suffix="[suf]", middle="[mid]")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    row = I.infill_texts(docs, plan).first()
    assert row["form"] == "psm" and row["output"].startswith("[pre]")
    assert row["output"].index("[suf]") < row["output"].index("[mid]")
    text = I.infill_texts(docs, plan).select(I.restored_text(F.col("output"), F.col("form"), plan)).first()[0]
    assert text == "alpha beta gamma delta"
