import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASHING = "content bucket row spot score kept size start words n_words bin shard cluster h1 h2 best n sig bands node a b".split()


def prose(seed: int, n: int) -> str:
    """Words that differ with the seed."""
    return " ".join(f"{WORDS[(seed * 7 + i * i + i) % len(WORDS)]}{(seed * 31 + i * 17) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, copies, repeated rows."""
    base = prose(1, 60)
    return [
        (1, base, "en", "a"), (2, base.replace(" ", "  \n"), "en", "a"), (3, base + " more", None, "b"),
        (4, "", "en", "a"), (5, None, "en", None), (6, " \t\n", "en", "b"), (7, "one two three", "en", "b"),
        (None, base, "en", "a"), (None, None, None, None), (8, prose(2, 30_000), "en", "a"), (9, prose(3, 40), "de", "c"),
        (9, prose(3, 40), "de", "c"), (10, "x" * 300_000, "en", "c"), (11, "one two three", "en", "b"),
        (12, "Ünïcode ４２ 🙂 text ' quoted | piped # & <b>", "fr", "c"), (13, "same line\nsame line\nsame line\n", "en", "c"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
