import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, component_id int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    words = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    some = " ".join(f"alpha{i} beta{i}" for i in range(40))
    rows = [
        (1, some, "en", "a", 1), (2, some, "en", "b", 1), (2, some, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (None, some, "en", "a", 3),
        (None, None, None, None, None), (5, words, "de", None, 9), (6, words + " tail", "de", "é", 9), (7, "one two", "fr", "b", 1), (8, "ONE  two\n", "fr", "b", 1), (9, some + "\nline", "es", "c", 1),
        (10, " \t\n\x0b\f\r ", "es", "c", 1), (11, "日本語 テキスト 😀", "xx", "日", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
