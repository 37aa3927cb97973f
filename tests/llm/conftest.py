import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, _text string"


def awkward(seed: int = 3) -> list[tuple]:
    """Nulls in every column, empty and blank and long texts, ties, repeated rows, near copies, shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(140)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 1, 1, "x"), (2, base, "en", "b", 1, 1, None), (3, " ".join(near), None, "a", None, None, "y"), (4, "", "en", "a", 0, 1, "z"),
        (5, None, "en", None, None, 1, "z"), (6, " \t\n ", "en", "b", 3, 1, "z"), (7, "one two", "en", "b", 7, 1, "z"), (7, "one two", "en", "b", 7, 1, "z"), (None, prose(30), None, None, None, None, None),
        (8, prose(50) + " " + passage + " " + prose(20), "de", "a", 1, 1, "q"), (9, passage + "\n" + prose(90), "de", "b", 1, 1, "q"), (10, "word " * 3000, "en", "c", 1, 1, "q"), (11, prose(4000), "fr", "c", 1, 1, "q"),
        (12, "ONE Two", "en", "c", 1, 1, "q"), (13, base.upper(), "en", "c", 1, 1, "q"),
    ]
    return rows + [(100 + i, prose(r.randint(1, 60)), r.choice(["en", "de"]), r.choice("abcd"), 1, 1, "f") for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
