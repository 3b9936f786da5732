import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, hits int, items string, spans string, fp int, _gone int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = words(30_000, 1)
    base = words(120, 2)
    rows = [(1, base), (2, base), (3, base + " changed"), (4, ""), (5, None), (6, "   \n \t "), (7, long), (8, words(80, 3)), (8, words(80, 3)), (9, "one"), (10, "é ü ñ 漢字 😀"), (None, words(60, 4)), (11, "a\n\nb\nA\n" + base[:60] + "\n" + base[:60] + "x")]
    return [(i, t, "en", "src0", None if t is None else len(t), "x", "y", 1, "z", "s", 2, 3) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
