from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, start=0):
    return [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts (or of whole rows)."""

    def make(texts, schema=SCHEMA):
        rows = texts if texts and isinstance(texts[0], tuple) else rows_of(texts)
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def sf(spark, tmp_path):
    """Writes tables into a folder as the queries read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


#: Null, empty, white space, one word, odd characters, repeats, and a very long text.
ODD = [None, "", " \n\t ", "word", "é ﬁ 日本語 \u0000 ▁ <s> 🤖", "a b c " * 50, "same text here\nsame text here", "same text here\nsame text here", "x" * 30_000, " ".join(f"w{i % 977}" for i in range(20_000))]


def prose(rnd: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))
