"""Documents that no operator may stumble over."""

#: NULL ids and texts, empty and blank texts, repeated rows, ties, and a very long text.
ODD = [
    (None, None), (None, "only a null id here with a few words in it"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"),
    (5, "!!! ... ???"), (6, "word " * 60_000), (7, "Ünïcödé ﬀ \u2028 text 漢字 🎉 " * 5), (7, "same id, another text"), (8, "a\x00b"),
]


def docs_of(spark, pairs):
    """A table of documents with clashing extra columns from (doc_id, text) pairs."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, label long, size string, n long, row string"
    rows = [(i, t, "en", None if i is None else f"s{i % 3}", None, "k", 1, "x", None, "r") for i, t in pairs]
    return spark.createDataFrame(rows, schema)
