"""Marker slicing M1-M7 and its traps."""
from pyspark.sql import functions as F

from quire.operators.slices import extract_content, slice_items, str_array


def _items(spark, pages):
    rows = [(pid, i, "text", "Normal", t) for pid, texts in pages.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id long, idx int, type string, style string, full_text string")


def _texts(df):
    out = {}
    for r in df.orderBy("page_id", "idx").collect():
        out.setdefault(r.page_id, []).append(r.full_text)
    return out


def test_start_one_before_stop_excluded(spark):
    df = _items(spark, {1: ["a", "b", "START here", "c", "STOP", "d"]})
    got = _texts(slice_items(df, str_array(["start"]), str_array(["stop"])))
    assert got == {1: ["b", "START here", "c"]}


def test_no_start_gives_nothing(spark):
    df = _items(spark, {1: ["a", "b"]})
    assert slice_items(df, str_array(["zzz"]), str_array([])).count() == 0


def test_start_at_zero_and_stop_tested_from_start_plus_one(spark):
    # start hit at item 0 -> start 0; item 0 is never tested for stop; item 1 is
    df = _items(spark, {1: ["start stop", "stop", "x"], 2: ["x", "start", "stop y"]})
    got = _texts(slice_items(df, str_array(["start"]), str_array(["stop"])))
    assert got == {1: ["start stop"], 2: ["x", "start"]}


def test_empty_marker_matches_everything(spark):
    df = _items(spark, {1: ["a", "b", "c"]})
    got = _texts(slice_items(df, str_array([""]), str_array([""])))
    assert got == {1: ["a"]}


def test_extract_content_remove_source_renumber(spark):
    df = _items(spark, {1: ["pre", "Start", "Full Series", "body", "end"], 2: ["no marker"]})
    urls = spark.createDataFrame([(1, "https://x/1"), (2, "https://x/2")], "page_id long, url string")
    out = extract_content(df, urls, str_array(["start"]), str_array(["end"]), str_array(["full series"]))
    got = [(r.page_id, r.idx, r.full_text) for r in out.orderBy("page_id", "idx").collect()]
    assert got == [(1, 0, "pre"), (1, 1, "Start"), (1, 2, "body"), (1, 3, "Content Source - https://x/1")]


def test_page_with_only_start_keeps_source_line(spark):
    df = _items(spark, {1: ["Start", "x"]})
    urls = spark.createDataFrame([(1, "u")], "page_id long, url string")
    out = extract_content(df, urls, str_array(["start"]), str_array(["x"]), str_array(["start"]))
    assert [r.full_text for r in out.orderBy("idx").collect()] == ["Content Source - u"]


def test_removal_table_equals_the_list(spark):
    from quire.operators.slices import remove_text
    rows = {i: ["Keep %d" % i, "BOILER plate", "x", "tail"] for i in range(60)}
    df = _items(spark, rows)
    gone = ["boiler PLATE", "X", "never there"]
    table = spark.createDataFrame([(t,) for t in gone * 3] + [(None,)], "text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted((r.page_id, r.idx, r.full_text) for r in remove_text(df, gone).collect())
    assert len(want) == 120
    try:
        for limit in ("-1", before):                                  # joined by line, or broadcast
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = remove_text(df, table)
            assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (limit != "-1")
            assert sorted((r.page_id, r.idx, r.full_text) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.page_id, r.idx, r.full_text) for r in remove_text(df, table.limit(0)).collect()) == sorted(
        (r.page_id, r.idx, r.full_text) for r in df.collect())
