import random

import pytest

WORDS = "river stone cloud paper window garden silver morning anchor basket candle dragon engine forest hammer island jacket kettle ladder magnet needle orange pencil quartz rocket saddle timber umbrella velvet walnut".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def prose():
    """Reproducible text of n words."""
    def make(n: int, seed: int) -> str:
        draw = random.Random(seed)
        return " ".join(draw.choice(WORDS) for _ in range(n))
    return make


@pytest.fixture()
def documents(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a table like ``documents``."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:] + ("en", "src0")[len(r) - 2:]), None if r[1] is None else len(r[1])) for r in map(tuple, rows)]
        return spark.createDataFrame(full, DOC).repartition(3)
    return make


@pytest.fixture()
def odd(documents, prose):
    """Null id, null text, empty, blank, very long, repeated rows, null lang and source."""
    return documents([(1, None), (2, ""), (3, " \t\n"), (None, prose(40, 1)), (4, prose(60_000, 2)), (5, prose(30, 3)), (5, prose(30, 3)),
                      (6, prose(30, 4), None, None), (7, "x" * 300_000, "en", None), (8, "é" * 500)])
