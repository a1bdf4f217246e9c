import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def odd_texts():
    """Null, empty, white space, ties, repeated rows, one very long text, and other scripts."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog and runs away\nsecond line of the text with more words"
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, None, 0),
        (3, " \t\r\n\x0b\x0c ", "en", "a", 7),
        (4, plain, "en", "a", len(plain)),
        (4, plain, "en", "a", len(plain)),
        (5, plain, "de", None, len(plain)),
        (5, "another text under the same id as the one before it", "en", "b", 1),
        (6, long, "en", "a", len(long)),
        (7, long + " end", "en", "a", len(long)),
        (8, "Ünïcode, 漢字 und 👍🏽 é <|endoftext|> İ Σ", "de", "b", 1),
        (None, "a row without an id has words too", None, "b", 1),
        (9, "x" * 5000, "en", "b", 5000),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows with extra columns that have names the operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_texts(), SCHEMA)
    return docs.withColumns({c: F.lit("x") for c in ("rid", "name", "pos", "_f0", "row", "removed", "score", "key", "n", "ids", "label", "_removed_lines")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
