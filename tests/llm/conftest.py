"""Documents with every awkward case, for all operators."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and", "to", "in", "river", "stone", "Garden", "light", "winter", "über", "ciónes", "walks", "quiet", "house", "letter", "morning", "over", "under", "bright"]
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward() -> list[tuple]:
    a, b, c = prose(1, 120), prose(2, 200), prose(3, 90)
    shared = prose(4, 70)
    rows = [
        (1, a, "en", "s1", 1), (2, a, "en", "s2", 1), (3, b, "de", "s1", 2), (4, b[:400] + " changed " + b[400:], "de", None, 2),
        (5, None, None, "s1", None), (6, "", "en", "s2", 0), (7, " \n\t ", "en", "s3", 4), (None, c, "fr", "s1", 5), (8, c + "\n" + shared, "fr", "s1", 5),
        (9, shared + "\n" + prose(5, 40), None, None, 6), (10, prose(6, 30_000), "en", "s1", 7), (11, "ab" * 400, "en", "s2", 8), (12, "x\n" * 30, "en", "s2", 8),
        (13, "one two three", "en", "s3", 3), (13, "one two three", "en", "s3", 3), (14, "line one\nline two\nline three\nend " + prose(7, 15), "en", "s1", 1),
        (15, "start\nline one\nline two\nline three\n" + prose(8, 15), "en", "s1", 1), (16, prose(9, 60) + " THE!! END%%% " + "ÀÉ", "fr", "", 1), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


#: Names that operators use inside.
CLASHES = ("size", "shard", "slot", "h", "n_words", "fp", "words", "taken", "target", "dk", "component_id", "rank", "law", "kept", "spans")


def clash(df):
    """df with columns of the operators' own names."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("mine").alias(c) for c in CLASHES))
