import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs or longer rows."""

    def docs(rows, extra=""):
        full = [(r + (None,) * 5)[:5] if not extra else r for r in map(tuple, rows)]
        return spark.createDataFrame(full, DOCS + extra)

    return docs


@pytest.fixture(scope="session")
def prose():
    """Seeded prose of a small language."""

    def text(seed, n=80, words=400):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abdegiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(n)) if words else ""

    return text


@pytest.fixture(scope="session")
def hard(prose):
    """Texts that any operator must stand: null, empty, blank, control characters, other scripts, very long, repeated rows."""
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "a\x00b\x01 c"), (5, "語" * 300 + " İstanbul ñandú 😀"), (6, "x" * 200_000), (7, "word " * 30_000),
        (8, prose(1)), (8, prose(1)), (9, prose(1)), (None, prose(2)), (10, prose(2)), (None, None), (11, "\n\n\n"), (12, "one"), (13, "a b c d"),
    ]
