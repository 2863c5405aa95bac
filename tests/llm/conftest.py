import random

import pytest

WORDS = [a + b for a in ("th", "er", "on", "an", "st", "re") for b in ("ing", "ed", "en", "ou", "ly", "and")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, line string, lang_pred int, predicted string, removed int, fp long, node string, `a b` int"

MORE = (1, "p", 2, 3, "n", 4)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in every column, empty and blank texts, ties, copies, repeated rows, one long text."""
    rng = random.Random(7)
    base = [prose(rng, 60) for _ in range(12)]
    texts = [None, "", " \n\t ", "a", "Ünïcode ñandú 日本 🙂", base[0], base[0], base[1], base[1] + " x", base[2].upper(), "<|endoftext|> " + base[3], "\n".join(base[4:8]), prose(rng, 6000), *base[8:]]
    rows = [(i, t, [None, "en", "de"][i % 3], None if i % 4 == 0 else "s", None if t is None else len(t), 0.5, "x", "y", *MORE) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base[9], None, None, None, None, None, None, *MORE), (-3, base[10], "en", "s", 1, None, None, None, *MORE)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
