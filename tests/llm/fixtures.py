"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank long"


def odd_documents(spark):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10, 1, 1),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10, 1, 1),
        (3, None, "en", None, None, None, None),
        (4, "", None, "b", 0, 2, 2),
        (5, " \t\r\n\x0b\x0c ", "de", "b", 7, 2, 2),
        (6, "one", "fr", "c", 3, 2, 2),
        (7, "ONE two", "fr", "c", 3, 2, 2),
        (8, "12345 !!! ---", "es", "c", 3, 2, 2),
        (9, "wort " * 30_000, "de", "a", 150_000, 3, 3),
        (10, "non breaking   space \U0001f600 naïve", "en", "", 4, 2, 2),
        (None, "a row without an id is still a row of words", "en", "a", None, None, None),
        (11, "repeated row of words", "en", "a", 1, 1, 1),
        (11, "repeated row of words", "en", "a", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
