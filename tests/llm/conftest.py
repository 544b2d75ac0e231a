import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, copies, and clashing extra columns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, passage), (4, passage + " tail one"), (5, "head " + passage), (6, "12 !! 34"), (7, "The of"), (7, "The of")]
    base = [word() for _ in range(80)]
    for i in range(12):
        w = list(base)
        w[i] = "changed"
        rows.append((10 + i, " ".join(w)))
    rows += [(30 + i, "\n".join(" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6)))) for i in range(20)]
    rows += [(60, " ".join(word() for _ in range(6000))), (61, "x" * 5000), (62, "la la " * 300), (63, passage.upper())]
    full = [(d, t, None if i % 5 == 0 else "ab"[i % 2], None, None, "h", i, "k") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS + ", h string, did int, places string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
