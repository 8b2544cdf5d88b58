"""Streaming driver, config reader (S2/S3), manifest checks (S4/S8), J6/J7 lookups."""
import json

from pyspark.sql import functions as F

from conftest import pages_df
from quire.operators.site import available_style, template_lookup
from quire.sources.tables import (book_manifest, marker_table, read_config, template_table)
from quire.streaming.pages import stream_page_content


def test_stream_pages_to_content(spark, tmp_path):
    src = str(tmp_path / "in")
    pages_df(spark, [(1, "https://x/1", "<article><p>a</p><p>Start</p><p>b</p></article>")]).write.parquet(src + "/f1")
    pages_df(spark, [(2, "https://x/2", "<article><p>Start</p><p>c</p></article>")]).write.parquet(src + "/f2")
    q = stream_page_content(spark, src + "/*", str(tmp_path / "out"), str(tmp_path / "ck"),
                            ["start"], [], [])
    q.awaitTermination(120)
    got = sorted((r.page_id, r.idx, r.full_text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "a"), (1, 1, "Start"), (1, 2, "b"), (1, 3, "Content Source - https://x/1"),
                   (2, 0, "Start"), (2, 1, "c"), (2, 2, "Content Source - https://x/2")]


def test_read_config_defaults_and_markers(spark, tmp_path):
    full = {"_comment": "x", "start_markers": ["a"], "stop_markers": ["b", "c"], "remove_text": [],
            "max_chapters": 150, "max_depth": 3, "main_templates": {"english": "m_en.docx"},
            "other_templates": {"english": "o_en.docx"}, "template_folder": "T",
            "start_markers_commented": ["zzz"], "browser": {"headless": False, "timeout_ms": 30000}}
    bare = {"start_markers": ["ஸ்ரீ"]}
    (tmp_path / "config.json").write_text(json.dumps(full, indent=2), encoding="utf-8")
    (tmp_path / "config_bare.json").write_text(json.dumps(bare, indent=2), encoding="utf-8")
    cfg = read_config(spark, str(tmp_path))
    rows = {r.config_id: r for r in cfg.collect()}
    assert rows["config_bare.json"].max_chapters == 100 and rows["config_bare.json"].max_depth == 1
    assert rows["config_bare.json"].toc_selector == "li > a[href]"
    assert rows["config.json"].max_depth == 3 and rows["config.json"].start_markers == ["a"]
    m = marker_table(cfg).filter(F.col("config_id") == "config.json").orderBy("kind", "pos").collect()
    assert [(x.kind, x.marker) for x in m] == [("start_markers", "a"), ("stop_markers", "b"), ("stop_markers", "c")]

    books = spark.createDataFrame(
        [(1, "config.json", "main", "English"), (2, "config.json", "other", "english"),
         (3, "config.json", "weird", "english"), (4, "config.json", "main", "klingon")],
        "book_id long, config_id string, book_type string, language string")
    tpl = template_lookup(books, template_table(cfg), cfg.select("config_id", "template_folder"))
    assert {r.book_id: r.template for r in tpl.collect()} == {1: "T/m_en.docx", 2: "T/o_en.docx",
                                                               3: "T/m_en.docx", 4: None}


def test_style_fallback(spark):
    lines = spark.createDataFrame([("t1", "text", "List Bullet", "x"), ("t2", "text", "List Bullet", "y"),
                                   ("t2", "text", "Heading 3", "h")],
                                  "template string, kind string, style string, text string")
    styles = spark.createDataFrame([("t1", ["List Bullet", "Normal"]), ("t2", ["Normal"])],
                                   "template string, styles array<string>")
    got = {(r.template, r.style): (r.used_style, r.bullet_indent, r.text)
           for r in available_style(lines, styles).collect()}
    assert got == {("t1", "List Bullet"): ("List Bullet", False, "x"),
                   ("t2", "List Bullet"): ("Normal", True, "• y"),
                   ("t2", "Heading 3"): ("Normal", False, "h")}


def test_manifest_reasons(spark):
    rows = [(1, "https://a.example/x", "b.docx", "main"), (2, "ftp://a.example/x", "b.docx", "main"),
            (3, "https://a.example/x", "../b.docx", "main"), (4, "https://a.example/x", "b.DOCX", "other"),
            (5, "https://a.example/x", "b.pdf", "main"), (6, "https://a.example/x", "b.docx", "comic"),
            (7, "http://localhost/", "b.docx", "main")]
    df = spark.createDataFrame(rows, "book_id long, url string, out_name string, book_type string") \
        .withColumn("title", F.lit("t")).withColumn("language", F.lit(None).cast("string")) \
        .withColumn("config_id", F.lit("c"))
    got = {r.book_id: r.reject_reason for r in book_manifest(df).collect()}
    assert got == {1: None, 2: "scheme", 3: "parent_dir", 4: None, 5: "not_docx", 6: "book_type",
                   7: "local_host"}
