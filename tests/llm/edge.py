"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, spans string, row string, id long, "
          "bucket long, kind string, n long, key string, term string, score double, component string, `range` long, a string")
LONG = " ".join(f"word{i} the of" for i in range(4000))


def rows():
    def row(doc_id, text, lang="en", source="s"):
        return (doc_id, text, lang, source, None if text is None else len(text), "x", "y", 1, 2, "k", 3, "q", "t", 0.5, "c", 9, "a")
    plain = "the cat of the house and a dog with one more thing to say about it"
    return [row(1, plain), row(1, plain), row(2, plain), row(3, None), row(4, ""), row(5, "  \n "), row(None, "no id the text"),
            row(None, None), row(6, "x", None, None), row(7, LONG), row(8, LONG + " end"), row(9, "é à ü 中文 😀 the"),
            row(10, "token: abcdefgh12 a.b@c.de 1.2.3.4 +1 (386) 555-3733, 4111 1111 1111 1111")]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (None, 1, 1), (7, 0, 1), (7, 0, 1), (10, 1, 0)],
                                 "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x))


def all_ids():
    return sorted((r[0] for r in rows()), key=lambda x: (x is not None, x))
