from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "sk", "lt", "")]


def prose(seed: int, n: int) -> str:
    """n words, ten a line; no window of words repeats except by chance."""
    import random

    draw = random.Random(seed)
    words = [draw.choice(WORDS) + str(draw.randrange(10)) * (i % 7 == 0) for i in range(n)]
    return "\n".join(" ".join(words[i : i + 10]) for i in range(0, n, 10))


#: doc_id, text, source: nulls, empty and blank texts, one word, a very long text, repeated rows, ties, symbols.
ODD = [
    (1, None, "a"), (2, "", None), (3, " \t\n \r", "a"), (4, "word", "a"), (None, prose(4, 80), "a"), (None, None, None),
    (5, prose(5, 60), "a"), (5, prose(5, 60), "a"), (6, prose(5, 60), "b"), (7, prose(7, 6000) + " \n" + "x" * 5000, "b"),
    (8, "é😀 ß #*$%&|<>\n\n" + prose(8, 70), None), (9, "same line here\n" * 40, "a"), (10, "A B\x0bC\x1cD E", "a"),
]
#: Names that operators use inside.
CLASHING = ["th", "host", "id", "path", "label", "bits0", "size", "shard", "n_words", "cell", "width", "item", "row_hash", "row_id", "found", "base", "kept", "rest", "node", "key", "slot", "_salt", "removed", "d", "_id", "_th", "_host", "_text", "_spans", "_removed", "hash", "gone", "left_text", "spans", "covered", "k", "k_id", "place", "fold", "y"]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    return frame(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark: SparkSession) -> DataFrame:
    return frame(spark, [])
