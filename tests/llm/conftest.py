import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared passages, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(4)
    base = [words(rng, n) for n in [0, 1, 3, 5, 34, 35, 36, 60, 90, 120, 200, 300, 2500] + [80] * 12]
    texts = [" ".join(w) for w in base]
    passage = words(rng, 55)
    for w in base[8:12]:
        texts.append(" \t".join([*w[:20], *passage, *w[20:]]))
    for i in range(10):  # near copies
        w = list(base[9])
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = "new%d" % rng.randrange(99)
        texts.append(" ".join(w))
    texts += [texts[10]] * 6 + [texts[7].upper(), None, "", "  \n\t ", "solo", "é à ü " * 9, " ".join(["same"] * 120)]
    rows = [(i, t, "en", [None, "a", "b", "", "ä", "c"][i % 6] if i % 2 else "a", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[20], (None, texts[9], "en", "b", 1), (None, None, None, None, None)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(docs):
    """With further columns named like results and like nothing."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("score", "predicted", "size", "taken", "n_words", "kept", "copies", "id", "k1", "c0", "Other Name", "starts", "step", "rank")})
