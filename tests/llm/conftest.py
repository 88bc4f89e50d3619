from __future__ import annotations

import pytest

# nulls, empty and long texts, ties and repeated rows, extra columns with clashing names
ODD = [
    (1, "The Cat sat on the mat and the dog sat on the log", "x"), (2, "the cat SAT on the mat and the dog sat on the log", None), (3, None, "y"), (4, "", None), (5, " \t\n", "z"), (6, "one", "x"), (6, "one", "x"), (6, "two words", "x"),
    (None, "no id here at all, none of it", "x"), (None, None, None), (7, "naïve café № ☃ 中文 ١٢", "x"), (8, "word " * 30_000, "x"), (9, "é" * 20_000, "x"), (10, "a b c d e f g h i j k l m n o p " * 8, "x"), (11, "zero a b c d e f g h i j k l m n o p " * 8, "x"),
]
EXTRA = ["digest", "norm", "uid", "node", "comp", "kept_id", "dropped_id", "text_sha256", "score", "slot", "shard", "label", "rid", "zipped", "n_words", "hit_words", "length", "part", "bucket", "_hit_words", "_kept_id", "_kept_key", "_content", "spans", "n", "form", "h1"]


@pytest.fixture(scope="session")
def odd(spark):
    names = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, *[x] * len(EXTRA)) for i, t, x in ODD], f"doc_id long, text string, {names}").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
