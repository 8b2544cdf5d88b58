"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job is forced with a ``noop`` write (every row computed, nothing collected).
The derived site (F-SITE) is written once to a scratch folder first; that fixture
time is reported as ``site_fixture`` but is not part of the headline value, which is
the sum of the library jobs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans import queries as Q  # noqa: E402
from quire.plans.books import BookConfig, build_books  # noqa: E402
from quire.plans.site_fixture import SITE_CONFIG, site_books, site_pages  # noqa: E402
from quire.session import build_session  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="quire-bench", shuffle_partitions=2 * cpus)
    scratch = tempfile.mkdtemp(prefix="quire-bench-")
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    # warm-up: JVM and code generation, not part of any figure
    _run(Q.q_page_items(spark, os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
                        if os.path.isdir(os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")) else sf))

    timed("page_items", lambda: _run(Q.q_page_items(spark, sf)))
    timed("detect_chapters", lambda: _run(Q.q_detect_chapters(spark, sf)))
    timed("scrape_page", lambda: _run(Q.q_scrape_page(spark, sf)))
    timed("lines_source", lambda: _run(Q.q_lines_source(spark, sf)))

    site_dir = os.path.join(scratch, "site")
    fixture_t = time.time()
    site_pages(spark, sf).write.mode("overwrite").parquet(site_dir)
    fixture_s = round(time.time() - fixture_t, 3)
    pages = spark.read.parquet(site_dir)
    books = site_books(spark, sf)
    cfg = BookConfig.from_dict({**SITE_CONFIG, "include_images": True})

    run_holder = {}

    def expand():
        run_holder["run"] = build_books(pages, books, cfg)  # checkpoints each level
        _run(run_holder["run"].sections)

    timed("expand_site", expand)
    timed("book_lines", lambda: _run(run_holder["run"].lines))

    value = round(sum(times.values()), 3)
    out = {"metric": "total_query_seconds", "value": value, "unit": "sec",
           "queries": {**times, "site_fixture": fixture_s}, "sf": os.path.basename(sf.rstrip("/")),
           "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
