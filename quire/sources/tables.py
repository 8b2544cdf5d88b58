"""Sources: driver tables (S1), item views of ordered text, config (S2, S3),
book manifest (S4, S8), image lookup (S5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as TX
from quire.functions import urls as U
from quire.operators.links import selector_parent

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lines_as_items(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each non-blank line of a document is an item, ``idx`` from 0 in line order.

    ``(page_id, idx, type, style, full_text)`` with ``page_id`` = the document key.
    Documents are hash-partitioned by key *before* the explode, so the per-document
    windows that follow (slicing, dedup) reuse the partitioning instead of shuffling
    exploded lines.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = documents.select(F.col(key).alias("page_id"), F.col(text).alias("_t")).repartition(n, "page_id")
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("_t"), F.lit("")), "\n"),
                                 lambda s: TX.collapse_ws(s)), lambda s: s != "")
    return d.select("page_id", F.posexplode(lines).alias("idx", "full_text")).select(
        "page_id", "idx", F.lit("text").alias("type"), F.lit("Normal").alias("style"), "full_text")


def turns_as_items(conversations: DataFrame) -> DataFrame:
    """Each conversation turn is an item: ``page_id`` = conv_id, ``idx`` = turn rank."""
    from pyspark.sql import Window
    c = conversations.select(F.col("conv_id").alias("page_id"), "turn", "role",
                             TX.collapse_ws(F.coalesce(F.col("text"), F.lit(""))).alias("full_text"))
    w = Window.partitionBy("page_id").orderBy("turn")
    return c.select("page_id", (F.row_number().over(w) - 1).alias("idx"), F.lit("text").alias("type"),
                    F.lit("Normal").alias("style"), "full_text", "role")


# ------------------------------------------------------------------ config
CONFIG_SCHEMA = T.StructType([
    T.StructField("start_markers", T.ArrayType(T.StringType())),
    T.StructField("stop_markers", T.ArrayType(T.StringType())),
    T.StructField("remove_text", T.ArrayType(T.StringType())),
    T.StructField("toc_selector", T.StringType()),
    T.StructField("max_chapters", T.IntegerType()),
    T.StructField("max_depth", T.IntegerType()),
    T.StructField("reading_mode", T.BooleanType()),
    T.StructField("include_images", T.BooleanType()),
    T.StructField("template_folder", T.StringType()),
    T.StructField("book_type", T.StringType()),
    T.StructField("main_templates", T.MapType(T.StringType(), T.StringType())),
    T.StructField("other_templates", T.MapType(T.StringType(), T.StringType())),
    T.StructField("browser", T.StructType([
        T.StructField("headless", T.BooleanType()),
        T.StructField("timeout_ms", T.IntegerType())])),
])

# Defaults the reference applies when a key is absent.
CONFIG_DEFAULTS = {"toc_selector": "li > a[href]", "max_chapters": 100, "max_depth": 1,
                   "include_images": False, "book_type": "main", "reading_mode": True,
                   "template_folder": "", "timeout_ms": 30000, "headless": False}


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON config file, defaults filled, ``config_id`` = file name.

    Keys outside the schema (``_comment``, ``*_commented``) are dropped by the reader.
    """
    raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    return _with_defaults(raw, F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def parse_configs(configs: DataFrame, id_col: str = "config_id", json_col: str = "json") -> DataFrame:
    """S2 on a table of configs: one row per JSON string, defaults filled.  A string that is no
    JSON object gives no row; null entries of the lists are dropped."""
    schema = T.StructType([*CONFIG_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = configs.select(configs[id_col].cast("string").alias("_id"), F.from_json(configs[json_col], schema).alias("c"),
                         F.coalesce(configs[json_col].rlike(r"^\s*\{"), F.lit(False)).alias("_object"))
    raw = raw.filter(F.col("_object") & F.col("c._corrupt_record").isNull()).select("_id", "c.*")
    return _with_defaults(raw, F.col("_id"))


def _with_defaults(raw: DataFrame, config_id: F.Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    d = CONFIG_DEFAULTS
    return raw.select(
        config_id.alias("config_id"),
        F.array_compact(F.coalesce("start_markers", empty)).alias("start_markers"),
        F.array_compact(F.coalesce("stop_markers", empty)).alias("stop_markers"),
        F.array_compact(F.coalesce("remove_text", empty)).alias("remove_text"),
        F.coalesce("toc_selector", F.lit(d["toc_selector"])).alias("toc_selector"),
        F.coalesce("max_chapters", F.lit(d["max_chapters"])).alias("max_chapters"),
        F.coalesce("max_depth", F.lit(d["max_depth"])).alias("max_depth"),
        F.coalesce("reading_mode", F.lit(d["reading_mode"])).alias("reading_mode"),
        F.coalesce("include_images", F.lit(d["include_images"])).alias("include_images"),
        F.coalesce("template_folder", F.lit(d["template_folder"])).alias("template_folder"),
        F.coalesce("book_type", F.lit(d["book_type"])).alias("book_type"),
        F.coalesce("main_templates", F.create_map().cast("map<string,string>")).alias("main_templates"),
        F.coalesce("other_templates", F.create_map().cast("map<string,string>")).alias("other_templates"),
        F.coalesce(F.col("browser.headless"), F.lit(d["headless"])).alias("headless"),
        F.coalesce(F.col("browser.timeout_ms"), F.lit(d["timeout_ms"])).alias("timeout_ms"),
    )


def marker_table(config: DataFrame) -> DataFrame:
    """S3: ``(config_id, kind, pos, marker)`` rows from the three config lists."""
    parts = []
    for kind in ("start_markers", "stop_markers", "remove_text"):
        parts.append(config.select("config_id", F.lit(kind).alias("kind"),
                                   F.posexplode(kind).alias("pos", "marker")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compiled_configs(config: DataFrame) -> DataFrame:
    """What a job needs of each config: ``(config_id, start_re, stop_re, removed, selector,
    max_chapters, max_depth, include_images)`` — markers as one pattern each, the removal list in
    lower case, the link selector as its parent tag (NULL: a selector of another shape) and the
    depth within 1 to 3."""
    return config.select(
        "config_id", TX.marker_pattern(F.col("start_markers")).alias("start_re"),
        TX.marker_pattern(F.col("stop_markers")).alias("stop_re"),
        F.transform("remove_text", lambda x: F.lower(x)).alias("removed"),
        selector_parent(F.col("toc_selector")).alias("selector"),
        F.greatest(F.lit(1), F.col("max_chapters")).alias("max_chapters"),
        F.least(F.lit(3), F.greatest(F.lit(1), F.col("max_depth"))).alias("max_depth"), "include_images")


def template_table(config: DataFrame) -> DataFrame:
    """J6 input: ``(config_id, book_type, language, file)`` from the two template maps."""
    main = config.select("config_id", F.lit("main").alias("book_type"),
                         F.explode("main_templates").alias("language", "file"))
    other = config.select("config_id", F.lit("other").alias("book_type"),
                          F.explode("other_templates").alias("language", "file"))
    return main.unionByName(other)


# ------------------------------------------------------------------ manifest
BOOK_TYPES = ["main", "other"]


def output_name_reason(out_name) -> F.Column:
    """NULL when the output name is acceptable, else why not."""
    parts = F.split(F.coalesce(out_name, F.lit("")), r"[/\\]")
    return (F.when(out_name.isNull() | (out_name == ""), F.lit("no_output"))
            .when(F.exists(parts, lambda x: x == ".."), F.lit("parent_dir"))
            .when(~F.lower(out_name).rlike(r"\.docx$"), F.lit("not_docx")))


MANIFEST_SCHEMA = "book_id long, url string, title string, language string, book_type string, config_id string, out_name string"


def read_manifest(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Book jobs from JSON lines or CSV (with a header), judged in the same pass.

    Every row of the files is kept: good ones with ``reject_reason`` NULL, the others with the
    reason; a row that can't be read has reason ``corrupt`` and its text in ``raw``."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown manifest format {fmt!r}")
    reader = spark.read.schema(MANIFEST_SCHEMA + ", raw string").option("columnNameOfCorruptRecord", "raw")
    rows = reader.json(path) if fmt == "json" else reader.option("header", True).option("enforceSchema", True).csv(path)
    return book_manifest(rows)


def book_manifest(books: DataFrame) -> DataFrame:
    """Defaults filled, every row kept with ``reject_reason`` (NULL = valid).

    The reference stops the run at the first bad argument; here one bad book row is
    reported and the others still build (D7).
    """
    b = books.select(
        "book_id", "url", "title",
        F.lower(F.coalesce(F.col("language"), F.lit("english"))).alias("language"),
        F.coalesce(F.col("book_type"), F.lit("main")).alias("book_type"),
        "config_id", "out_name", *[c for c in ("raw",) if c in books.columns])
    corrupt = F.when(F.col("raw").isNotNull(), F.lit("corrupt")) if "raw" in books.columns else F.lit(None).cast("string")
    reason = F.coalesce(
        corrupt, U.url_reject_reason(F.col("url")),
        output_name_reason(F.col("out_name")),
        F.when(~F.col("book_type").isin(*BOOK_TYPES), F.lit("book_type")),
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.lit("no_title")))
    return b.withColumn("reject_reason", reason)


# ------------------------------------------------------------------ images
def image_lookup(items: DataFrame, images: DataFrame) -> DataFrame:
    """Image items get their bytes; an image whose download failed (no row in
    ``images``) is dropped, as the reference skips it silently."""
    img = items.filter(F.col("type") == "image")
    return img.join(images.select(F.col("url").alias("img_url"), "content"), "img_url", "inner")
