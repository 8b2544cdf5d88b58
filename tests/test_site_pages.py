"""The derived site: its pages are dealt out over tasks, with repeated and null keys as before."""
import pytest
from pyspark.sql import functions as F

from quire.plans.queries import q_image_lookup
from quire.plans.site_fixture import site_pages


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Two suppliers with one key, a supplier without nation, and pairs sold twice, of no part, or with a null key."""
    d = str(tmp_path_factory.mktemp("sf"))
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R & S")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(2, "N2", 0), (10, "N10", 0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
                     [(i, f"S{i}", 2, 1.0) for i in range(1, 41)] + [(1, "S1 again", 10, 1.0), (99, "S99", None, 1.0)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int", [(i, f"a<b {i}", "B", None, 3) for i in range(1, 6)]),
        "lineitem": ("l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_quantity double",
                     [(s, p, 9 * s, 1, 2.0) for s in range(1, 41) for p in range(1, 7)]
                     + [(1, 1, 3, 2, 5.0), (1, 1, 3, 1, 4.0), (1, 2, None, 1, 1.0), (1, None, 1, 1, 1.0), (99, 1, 1, 1, 1.0), (None, 1, 1, 1, 1.0)]),
        "documents": ("doc_id long, text string", [(0, "zero"), (1, "x\ny & z"), (2, None)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_pages_are_dealt_out(spark, sf):
    tasks = {r.lvl: r.n for r in site_pages(spark, sf).select("lvl", F.spark_partition_id().alias("k")).groupBy("lvl").agg(
        F.countDistinct("k").alias("n")).collect()}
    assert tasks[2] > 2 and tasks[3] > 1            # 41 suppliers and 246 pairs: both were one task beside the documents'


def test_pages_of_repeated_and_null_keys(spark, sf):
    rows = site_pages(spark, sf).filter("lvl = 3").collect()
    assert len(rows) == 39 * 6 + 2 * 7 and sum(r.html is None for r in rows) == 2 and not any("-s99-" in (r.url or "") for r in rows)
    body = next(r.html for r in rows if r.url == "https://books.example.org/2024/03/n2-s1-p1/")
    assert "<p>a&lt;b 1</p><p>Brand B, type , size 3</p><p>Order 3 line 1: 4 units</p><p>Order 3 line 2: 5 units</p><p>Order 9 line 1: 2 units</p><h2>" in body
    supplier = next(r.html for r in site_pages(spark, sf).filter("lvl = 2").collect() if r.url == "https://books.example.org/2024/02/n10-s1/")
    links = [f'<li><a href="/2024/03/n{n}-s1-p{p}/">Part {p}</a></li>' for p in range(1, 7) for n in (10, 2)]
    assert "".join(links) in supplier


def test_image_lookup_cuts_pages_once(spark, sf):
    plan = q_image_lookup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan             # items are a written table
