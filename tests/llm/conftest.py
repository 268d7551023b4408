import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns with names that the operators use inside
CLASHES = ["id", "row", "rank", "key", "doc", "_doc", "_row", "_at", "norm", "words", "size", "host", "label", "spans", "taken"]


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n)]
    return " ".join(words)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(7, 30_000)
    return [
        (1, prose(1, 80), "en", "a", 1), (2, prose(1, 80), "en", "a", 1), (2, prose(1, 80), "en", "a", 1), (3, None, "en", "a", 0), (4, "", "fr", None, 0),
        (5, " \n\t ", None, "b", 3), (6, long, "fr", "b", None), (None, prose(2, 60), "en", "b", 9), (None, None, None, None, None), (7, "x", "en", "c", 1),
        (8, prose(3, 120), "fr", "c", 5), (9, "naïve café — \U0001f600 ünïcode  double  spaces\r\n\tand tabs", "fr", "a", 2),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
