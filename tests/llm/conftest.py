import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"

#: null, empty and very long texts, ties, repeated rows, null ids and sources
DOCS = [
    (1, "The cat sat on the mat and looked at the dog for a very long while until it left.", "en", "a"),
    (2, "The cat sat on the mat and looked at the dog for a very long while until it left.", "en", "a"),
    (2, "The cat sat on the mat and looked at the dog for a very long while until it left.", "en", "a"),
    (3, None, "en", "b"), (4, "", None, None), (5, " \n\t ", "de", "b"), (6, "ein", "de", None),
    (None, "Der Hund und die Katze gehen nicht in das Haus von den Leuten.", "de", "b"),
    (None, "Der Hund und die Katze gehen nicht in das Haus von den Leuten.", "de", "b"),
    (8, "lang " * 30_000, "de", "c"), (9, "x" * 70_000, None, "c"), (10, "été \U0001f600 İ " * 40, "fr", "a"),
    (11, "x" * 300, "fr", "a"), (11, "something else altogether, " * 9, "en", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(*r, len(r[1] or ""), 7, "k") for r in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "fp long, `at` string")
