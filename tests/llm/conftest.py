import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{k % 997} and{k % 89}." for k in range(6000))
    base = "The quick brown fox jumps over the lazy dog while seven wizards quietly boxed up their jars of zinc and left the river town before dawn broke over the far hills. " * 2
    rows = [
        (1, base, "en", "a", 7, "x"),
        (1, base, "en", "a", 7, "x"),
        (2, base + "Mail bob.smith@mail.example.com or +44 20 7946 0958 now.", "en", "a", None, None),
        (3, None, None, None, None, None),
        (4, "", "en", None, 0, ""),
        (None, "Licensed under the Apache License, Version 2.0. ends", None, "a", 1, "y"),
        (5, long, "fr", "b", 2, "z"),
        (6, "  \n\t ", "fr", "b", 2, "z"),
        (7, "é à ü ñ 日本語 🙂 <|endoftext|> x  y ", "fr", "b", 2, "z"),
        (8, long + " tail", "fr", "b", 2, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string").withColumnsRenamed({"words": "keys"}).repartition(3)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
