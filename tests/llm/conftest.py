import random

import pytest

#: Columns that operators use inside, to see that clashing names do no harm.
EXTRA = ", score double, predicted int, size long, shard int, fp long, row long, key string, sid string, turn string, secrets string, kept string, node int, vec long, u long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ri", "tu", "sel", "mon"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(4)
    long = words(rng, 20_000)
    texts = [(1, "a b c d"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long + " end"), (7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, None), (8, "é ü \U0001f600 x\ny"), (9, words(rng, 60)), (10, words(rng, 60))]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s" + str(k % 2), None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    extra = (0.5, 1, 7, 3, 1, 2, "k", "s", "t", "x", "y", 4, 9, 8)
    return spark.createDataFrame([(*r, *extra) for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
