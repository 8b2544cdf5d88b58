import hashlib
import random
from collections import Counter

from quire.llm import mixing as M
from tests.llm import edge


def brute_rake(cells, targets, rounds=3000):
    """Scale the cells to each marginal in turn."""
    w = {k: float(n) for k, n in cells.items() if n}
    for _ in range(rounds):
        for axis, want in enumerate(targets):
            sums = Counter()
            for k, v in w.items():
                sums[k[axis]] += v
            w = {k: v * want[k[axis]] / sums[k[axis]] for k, v in w.items()}
    return {k: v / cells[k] for k, v in w.items()}


def tempered(cells, axis):
    sums = Counter()
    for k, n in cells.items():
        sums[k[axis]] += n
    total = sum(v ** M.TEMPER for v in sums.values())
    return {k: v ** M.TEMPER / total for k, v in sums.items()}


def make(seed=5, n=800):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.randint(1, 60)), r.choice("aaaaabcd") if i % 50 else None, r.choice(["en", "en", "fr", "de"]), r.choice("xyz"))
            for i in range(n)]


SCHEMA = "doc_id long, text string, source string, lang string, topic string"


def test_weights_equal_sequential_raking(spark):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.mix_weights(df, topic=df["topic"]).collect()
    cells = Counter()
    for _, text, source, lang, topic in rows:
        cells[(source, lang, topic)] += len(text.split())
    want = brute_rake(cells, [tempered(cells, a) for a in range(3)])
    total = sum(cells.values())
    for r in out:
        assert abs(r["weight"] - want[(r["source"], r["lang"], r["topic"])] * total) < 1e-6
        u = int(hashlib.md5(f"mix|{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r["sampled"] == (u < r["probability"])
    assert abs(sum(r["n_tokens"] * r["probability"] for r in out) / total - M.BUDGET) < 1e-6


def test_given_targets_and_full_cells(spark):
    rows = make(6)
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.mix_weights(df, topic=df["topic"], lang_target={"en": 1, "fr": 1, "xx": 5}, budget=0.9).collect()
    shares = Counter()
    for r in out:
        shares[r["lang"]] += r["n_tokens"] * r["weight"]
    assert shares["de"] == 0 and abs(shares["en"] - shares["fr"]) < 1e-6 * shares["en"]
    assert max(r["probability"] for r in out) == 1
    wanted = [r for r in out if r["weight"] > 0]
    assert abs(sum(r["n_tokens"] * r["probability"] for r in wanted) / sum(r["n_tokens"] for r in wanted) - 0.9) < 1e-6


def test_no_python_in_the_plan(spark):
    plan = M.mix_weights(edge.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edge_rows(spark):
    out = M.mix_weights(edge.docs(spark))
    assert edge.ids(out) == edge.all_ids()
    assert all(0 <= r["probability"] <= 1 for r in out.collect())
    kept = M.sample_mix(edge.docs(spark))
    assert kept.columns == edge.docs(spark).columns
    assert M.mix_weights(edge.empty(spark)).count() == 0 and M.sample_mix(edge.empty(spark)).count() == 0
    silent = edge.docs(spark).filter("text is null or text = ''")
    assert {r["probability"] for r in M.mix_weights(silent).collect()} == {0.0}
