"""Small tables for the edge cases that every operator must define."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside, as extra columns of the input
CLASHING = ("size", "h", "part", "copy", "n", "sk", "sig", "id", "key", "component", "score", "predicted", "ids", "row", "start", "target", "slot", "x", "kinds")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def edge_rows(seed: int = 3) -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, copies, repeated rows, odd characters."""
    rng = random.Random(seed)
    base = " ".join(words(rng, 60))
    long = " ".join(words(rng, 30_000))
    return [
        (0, base, "en", "a", len(base)),
        (1, base, "en", "b", len(base)),
        (2, None, "en", "a", None),
        (3, "", "en", "a", 0),
        (4, "  \n\t ", None, "b", 5),
        (5, "one", "en", None, 3),
        (6, long, "en", "a", len(long)),
        (7, "x" * 50_000, "en", "b", 50_000),
        (8, "日本語 ▁ é \u0000 🙂 <s> </s>\n", "de", "c", 20),
        (None, base + " tail", "en", "a", 1),
        (None, None, None, None, None),
        (9, "repeated row here", "en", "c", 17),
        (9, "repeated row here", "en", "c", 17),
    ]


def docs(spark: SparkSession, rows: list[tuple] | None = None, clash: bool = False) -> DataFrame:
    df = spark.createDataFrame(edge_rows() if rows is None else rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    return df


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
