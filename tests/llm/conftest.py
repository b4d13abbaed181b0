import random

import pytest

VOWELS, WORDS = "aeiou", 4000


@pytest.fixture(scope="session")
def vocabulary():
    rnd = random.Random(5)
    return ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice(VOWELS) for _ in range(rnd.randint(1, 4))) for _ in range(WORDS)]


@pytest.fixture(scope="session")
def prose(vocabulary):
    """prose(seed, n): n words of invented prose."""
    def make(seed, n):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def awkward(spark, prose):
    """Documents with nulls, empties, ties, repeated rows, a long text, marks beyond ASCII, and columns named as the operators' own."""
    base = prose(1, 120)
    texts = [base, base, base.replace(" ", "  "), base + " \n", base.upper(), "", None, " \t", prose(2, 5), prose(2, 5), "é", "É ñ\u3000x", prose(3, 40_000),
             base + " tail", "one", "one two", "one two three", "one two three", "日本語 テキスト", "a\x00b\x1fc", prose(4, 300) + " " + base]
    rows = [(i, t, "x", "y", i % 3, None) for i, t in enumerate(texts)] + [(3, texts[3], "x", "y", 0, None), (None, base, "x", "y", 1, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, `row` string, `key` string, `rid` int, lang string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
