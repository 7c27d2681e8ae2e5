import random

import pytest

WORDS = "the of and to river stone light garden window paper summer winter letter music bridge corner market doctor story village engine forest harbour silver mountain teacher kitchen history weather journey".split()


def prose(seed, n):
    """n words of made-up prose in lines; the same for the same seed."""
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(["", "", "s", "ly", "ing", "a", "en"]) for _ in range(n)]
    return "".join(w + (".\n" if i % 11 == 10 else " ") for i, w in enumerate(words)).strip()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with names the operators use themselves."""
    long = prose(1, 20_000)
    rows = [(1, prose(2, 60), "en", "a"), (1, prose(2, 60), "en", "a"), (2, None, None, None), (3, "", "de", "b"), (None, prose(3, 40), None, "a"),
            (None, None, "en", None), (4, " \n\t ", "en", "a"), (5, long, "en", "a"), (6, "x" * 50_000, "fr", "b"), (7, "é😀\u0000 ü", "es", "c")]
    rows = [(*r, len(r[1] or ""), "fp", 1.5, True, "key") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, kept boolean, root string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
