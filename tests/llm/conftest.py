import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]

#: Texts that any operator must take: null, empty, blank, marks only, short, repeated, other scripts, long.
ODD = [None, "", "  \n\t ", "... !!", "Word", "Word", "A b c d e f g h i j k l m n o p q r s t u v w x y z",
       "日本語のテキスト。 Ünïcödé ▁x <s> <|endoftext|> \x00 ﬁ", "the cat sat on the mat again\n" * 3000, "x" * 50_000]


@pytest.fixture
def odd(spark):
    """Odd texts with repeated ids and columns whose names clash with results."""
    rows = [(i % 9, t, "src", None if i == 3 else "en", 7, 1.5, "a") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words long, score double, labels string")


@pytest.fixture
def none(odd):
    return odd.where("doc_id < 0")
