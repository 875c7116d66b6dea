"""Tables with what no operator may stumble over."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, component long, key string, cluster long, text_key long, bucket int, rest string, kept string, score double, size long, label int, rank int, cuts string, _key string, own_key int, n_words long, n_removed long, held_out string, lang_pred string, `a.b` string, sealed int, c0 int, hub long"
LONG = "alpha beta gamma delta " * 8000


def _row(i, text, lang="en", source="web"):
    return (i, text, lang, source, None if text is None else len(text), 1, 2, "k", 3, 4, 5, "r", "kept", 0.5, 6, 7, 8, "cuts", "_key", 9, 77, 78, "no", "xx", "dot", 10, 11, 12)


def documents(spark):
    """Nulls in each column, empty, blank and very long texts, repeated rows and ids, clashing names."""
    some = "one two three four five six seven eight nine ten"
    rows = [
        _row(1, None), _row(2, ""), _row(3, " \t\n "), _row(4, some), _row(4, some), _row(5, some), _row(6, "a b"), _row(7, "a b"),
        _row(8, LONG), _row(9, LONG + "end"), _row(10, "x" * 200000), _row(11, some.upper()), _row(12, "12345 ...", None, None), _row(4, "other text of a repeated id"),
        (None, "a text without an id", "en", "web", 20, *[None] * 23),
        (13, None, *[None] * 26), _row(14, "é ü 😀   z"), _row(15, "one word\u0000with nul"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def multiset(rows):
    from collections import Counter

    return Counter(tuple(r) for r in rows)
