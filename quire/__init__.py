"""quire — captured web pages to numbered books, as Spark DataFrame jobs.

Every public function is ``DataFrame -> DataFrame`` (or returns a ``Column``), so a
whole crawl of many books runs as one Spark plan.
"""

__all__ = ["session"]
