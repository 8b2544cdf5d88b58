import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import rules as R
from tests.llm import edge


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b|😀", max_size=80), min_size=1, max_size=40))
def test_counts_equal_brute_force(spark, texts):
    rows = R.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute(texts[r["doc_id"]])


def test_table_compiles_to_verdicts(spark):
    good = "the small cat sat on the mat and looked at a bird in the old tree near it"
    texts = [good, good.upper(), " | ".join(good.split()), "\n".join([good] * 4), "word " * 40, "too short",
             "\n".join(f"{w} {i}..." for i, w in enumerate(good.split()))]
    rows = {r["doc_id"]: r for r in R.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["kept"] and rows[0]["broken"] == []
    assert [set(rows[i]["broken"]) >= b for i, b in enumerate(
        [set(), {"upper_char_ratio"}, {"symbol_ratio"}, {"repeat_word_ratio", "dup_line_ratio"}, {"repeat_word_ratio"}, {"n_words"},
         {"ellipsis_line_ratio"}])] == [True] * 7
    assert not any(rows[i]["kept"] for i in range(1, 7))


def test_no_python_in_the_plan(spark):
    plan = R.judge(edge.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_edge_rows(spark):
    out = R.judge(edge.docs(spark))
    assert edge.ids(out) == edge.all_ids()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[3]["base_failed"] and by[4]["n_words"] == 0 and by[1]["kept"] and by[7]["n_words"] == 12000
    kept = R.keep_good(edge.docs(spark))
    assert kept.columns == edge.docs(spark).columns and [i for i in edge.ids(kept)] == [1, 1, 2, 7, 8, 10]
    assert R.judge(edge.empty(spark)).count() == 0 and R.keep_good(edge.empty(spark)).count() == 0
