import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n long, at long"


def frame(spark, rows):
    """Documents with columns whose names operators use too."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, True, 7, 1) for i, t in rows], SCHEMA)


def words(rng, n, size=200):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, characters of all widths."""
    rng = random.Random(1)
    long = words(rng, 30_000, 5000) + " " + "x" * 20_000
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Café 中文 🙂 it's   done\r\n\r\n"), (6, long), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f"), (None, "no id here"), (9, "b\na\nb")]
