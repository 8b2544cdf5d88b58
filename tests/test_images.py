"""Image files, bytes once per content, failures listed."""
from quire.sources.images import image_bytes, read_images
from quire.sources.tables import image_lookup


def test_images_from_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in {"a/1.png": b"\x89PNG one", "a/2.png": b"\x89PNG one", "3.jpg": b"\xff\xd8 two", "empty.gif": b""}.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([("http://x/1", "a/1.png"), ("http://x/1b", "a/2.png"), ("http://x/3", "3.jpg"), ("http://x/3", "zzz.jpg"),
                                   ("http://x/e", "empty.gif"), ("http://x/n", "never.png"), ("http://x/null", None), (None, "3.jpg")],
                                  "url string, file string")
    images = read_images(spark, str(tmp_path), files)
    assert images.contents.count() == 2                               # two URLs show one picture
    assert {(r.url, r.bytes) for r in images.urls.collect()} == {("http://x/1", 8), ("http://x/1b", 8), ("http://x/3", 6)}
    assert len({r.sha256 for r in images.urls.collect()}) == 2
    assert {(r.url, r.reason) for r in images.failed.collect()} == {("http://x/e", "missing_or_empty"), ("http://x/n", "missing_or_empty"),
                                                                    ("http://x/null", "no_file")}
    items = spark.createDataFrame([(1, 0, "image", "http://x/1b"), (1, 1, "image", "http://x/n"), (1, 2, "text", None)],
                                  "page_id long, idx int, type string, img_url string")
    got = image_lookup(items, image_bytes(images.urls, images)).collect()
    assert [(r.idx, bytes(r.content)) for r in got] == [(0, b"\x89PNG one")]
