import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it for on stone river cloud amber tide lantern grove cipher maple harbor quartz ember falcon meadow".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while n > 0:
        k = min(n, r.randint(4, 15))
        out.append(" ".join(r.choice(WORDS) + r.choice(["", "", "s", "en"]) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


@pytest.fixture(scope="session")
def make(spark):
    def run(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return run


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and blank texts, one very long text and word, ties, repeated rows, and columns with clashing names."""
    base = [(i, prose(i, 60 + i), "en", f"s{i % 3}", 1) for i in range(12)]
    rows = base + [
        (100, None, "en", "s0", None), (101, "", None, "s1", 0), (102, "  \n\t ", "en", None, 5), (103, prose(7, 67), "en", "s2", 1), (104, prose(1, 9000), "fr", "s0", 1),
        (105, "x" * 5000, "en", "s1", 5000), (None, prose(3, 50), "en", "s1", 1), (None, None, None, None, None), base[0], base[0], (106, "Ünïcödé 𝒳 😀 ÉÀ ß", "de", "s2", 1), (107, "one two", "en", "s0", 7), (-5, prose(9, 30), "en", "s0", 3),
    ]
    df = make(rows)
    return df.withColumns({c: F.lit("own") for c in ("size", "part", "score", "k", "r", "fp", "shard", "copies", "label", "n_", "sigs", "h_", "predicted", "target")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
