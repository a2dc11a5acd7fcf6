import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, fp string, _row string, size double"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta river stone cloud paper window market garden silver copper engine".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Plain, copied, near-copied, empty, null, blank and very long texts."""
    rng = random.Random(7)
    plain = [sentence(rng, rng.randrange(60, 200)) for _ in range(30)]
    near = [" ".join([*p.split()[:-1], "changed"]) for p in plain[:6]]
    return [*plain, *plain[:4], *near, None, "", "  \n\t ", "one", "one two three", "ÀÉ ÎÕ naïve 東京 😀 text", sentence(rng, 40_000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with extra columns of clashing names, a null id, and rows that repeat."""
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), i, "x", "y", 1.5) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[5], "en", "a", 1, 0, "x", "y", 0.0), (5, "another text under an id that is taken", "en", "b", 1, 0, "x", "y", 0.0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
