"""Page keys of a book job: only the wanted ones are shuffled."""
from pyspark.sql import functions as F

from conftest import pages_df
from quire.operators.site import key_hash, key_rows, wanted_keys
from quire.session import written


def test_wanted_keys(spark):
    pages = pages_df(spark, [(3, "https://s/A/", ""), (2, "https://s/a#x", ""), (5, "https://s/b", ""), (7, None, "")])
    hashes = written(spark.createDataFrame([("https://s/a",), ("https://s/none",), (None,)], "u string").select(key_hash(F.col("u"))).distinct())
    assert [tuple(r) for r in wanted_keys(key_rows(pages), hashes).filter("page_key is not null").collect()] == [("https://s/a", 2)]
    plan = wanted_keys(key_rows(pages), hashes)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(page_key") < plan.index("LeftSemi")      # keys are dropped before the shuffle
