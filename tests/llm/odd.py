"""Documents with everything that may go wrong: nulls, empty, blank and very long texts, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, h long, start int, lines string, blob string, score double, key string, kept string, label int"
LONG = "one two three four five six seven eight nine ten " * 8000
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, LONG), (6, LONG), (6, LONG), (None, "a text without an id, of several words"), (None, None),
    (7, "tie tie tie\ntie tie tie\nShared line of text\n"), (8, "  SHARED LINE OF TEXT  \nother"), (9, "é à ü 你好 😀 ▁ <|endoftext|> \x1c\x85 x"),
]


def documents(spark, rows=TEXTS):
    extra = ("x", "y", 1, 2, 3, 4, "l", "b", 0.5, "k", "q", 5)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], SCHEMA)


def empty(spark):
    return documents(spark).limit(0)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda i: (i is None, i))


ALL_IDS = sorted((i for i, _ in TEXTS), key=lambda i: (i is None, i))
