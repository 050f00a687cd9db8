"""Hostile and plain tables shared by the tests of the training-data operators."""

from __future__ import annotations

import random

from odolake.llm.common import DOCUMENTS

SF = "/root/testdata/sf0.001"
#: Extra columns whose names operators use themselves.
MORE = ", node long, score double, key string, line int, h1 string, place string, i int"
EXTRA = (1, 0.5, "k", 2, "h", "p", 3)


def documents(spark, rows, extra: bool = False):
    """A documents table from (doc_id, text[, source[, lang]])."""
    full = []
    for r in rows:
        doc_id, text, source, lang = (*r, *(None,) * (4 - len(r)))
        full.append((doc_id, text, lang, source, None if text is None else len(text), *(EXTRA if extra else ())))
    return spark.createDataFrame(full, DOCUMENTS + (MORE if extra else ""))


def words(rng: random.Random, n: int, stock: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def hostile(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, equal texts, odd characters, clashing columns."""
    rng = random.Random(4)
    long = "\n".join(words(rng, 40) for _ in range(400))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, long, "a"), (6, long, "b"), (7, "x" * 5000, "a"),
        (8, "same line here for all\nand another one of them", None, "en"), (8, "same line here for all\nand another one of them", None, "en"),
        (9, "same line here for all\nÀ la carte — naïve 文字 🙂", "c"), (None, "no id at all", None), (None, None, None), (-3, "negative id", "c"),
        (10, "\n\n\n", "c"), (11, "a\x00b \x1c \x85 c", "c"), (1 << 40, long[:3000], "a"),
    ]
    return documents(spark, rows, extra=True)


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
