import random

import pytest

WORDS = "the of and a to in is that for with on as by it was are be this from at or an have not they which one you were all her would there their will when who him been has more if no out do so can what up said about other into than its time only could new them man some these then two first may any like now my such make over our even most me state after also made many must".split()


@pytest.fixture(scope="session")
def prose():
    """A maker of sentences: prose(seed, words)."""

    def make(seed: int, n: int) -> str:
        rnd = random.Random(seed)
        out = []
        while len(out) < n:
            line = [rnd.choice(WORDS) + rnd.choice(["", "", "ing", "s"]) for _ in range(rnd.randint(5, 12))]
            out += [line[0].capitalize(), *line[1:-1], line[-1] + "."]
        return " ".join(out[:n])

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, prose(1, 80), "a"), (1, prose(1, 80), "a"), (2, None, "a"), (3, "", None), (4, "   \n\t ", "b"), (5, "one", "b"), (6, "two words", None),
        (7, prose(7, 30_000), "a"), (8, "x" * 50_000, "b"), (None, prose(9, 60), "a"), (10, prose(1, 80), "c"), (11, "é 日本語 😀 mail@example.com\n+1 (743) 555-3824", "c"), (12, prose(7, 30_000) + " end", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.selectExpr("doc_id", "text", "'xx' as lang", "source", "length(text) * 1L as n_chars", "1 as id", "2 as key", "'z' as node", "3 as n", "4 as _key", "5 as h", "6 as word", "7 as size")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
