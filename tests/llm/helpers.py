"""Small tables with nulls, empty, long, tied and repeated rows, and columns whose names clash with the operators' own."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, most: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("w" + format(rng.randrange(most), "x") for _ in range(words))


def odd_rows():
    base = prose(1, 300)
    near = base.replace(" ", "  ", 3)
    return [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 0), (4, "one two", "fr", "b", 7),
        (5, base, "en", "a", 1), (6, base, "en", "b", 1), (6, base, "en", "b", 1), (7, near, "de", None, 1),
        (8, base + " tail of another kind", "en", "c", 1), (None, base, "en", "c", 1), (None, prose(9, 50), None, None, 1),
        (10, prose(2, 6000, 50_000), "es", "a", 1), (11, "x" * 30_000, "en", "b", 1),
        (12, "\n".join(prose(s, 12) for s in range(8)), "en", "b", 1),
        (13, "A b C é́ \U0001f389 <|endoftext|> don't 12.5 日本\n\n \tend ", "en", "", 1),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same rows with further columns named like columns that operators make."""
    names = ("size", "taken", "fp", "root", "piece", "n_tokens", "tag", "id", "row", "lines", "kept", "score", "shard", "d")
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def rows(df, *order):
    key = lambda r: tuple((v is None, "" if v is None else v) for v in r)
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=key)
