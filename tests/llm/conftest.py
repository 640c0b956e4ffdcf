import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, columns with clashing names."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta", "the", "of", "and", "überall"]
    long = " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(60_000))
    prose = ". ".join(" ".join(r.choice(words) + str(r.randrange(99)) for _ in range(12)) for _ in range(12))
    rows = [
        (1, prose, "en", "a"),
        (2, prose + " tail", "en", "a"),
        (3, prose.replace(" ", "\t"), "de", "b"),
        (4, None, None, None),
        (5, "", "en", ""),
        (6, "   \n\t ", "en", "b"),
        (7, long, "en", "b"),
        (8, long[:300_000] + " changed " + long[300_000:], None, "b"),
        (9, "1234 5678 !!", "fr", None),
        (10, "x", "fr", "c"),
        (None, "a row without id", "en", "a"),
        (None, None, None, None),
        (12, "twice", "en", "c"),
        (12, "twice", "en", "c"),
        (12, "same id, other text", "en", "c"),
        (13, prose, "en", "a"),
        (14, "nul \x00 byte and <|endoftext|> marker", "en", "a"),
        (15, "Der " * 400, "de", "a"),
    ]
    df = spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in rows], DOCS)
    from pyspark.sql import functions as F

    clash = ["size", "slot", "fp", "key", "score", "kept", "count", "digest", "spans", "part", "length", "start", "label", "root", "node", "copies", "target", "last", "repeats", "mix_hash", "mix_id", "_source", "_own", "_dropped", "_id", "_l", "_slot", "_digest", "_size", "_x_own", "_X_row", "raw", "run", "block", "revisit"]
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in clash]).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
