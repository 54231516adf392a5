import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "the", "of", "and", "river", "stone", "cloud", "Éclair", "straße", "naïve"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with exact and near copies, nulls, empties, repeated rows, a very long text, and clashing extra columns."""
    rng = random.Random(5)
    rows = []
    base = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    for i, t in enumerate(base):
        rows.append((i, t))
    for i in range(60, 90):  # exact copies in other case of A-Z
        rows.append((i, base[i % 7].upper() if i % 2 else base[i % 7]))
    for i in range(90, 150):  # near copies
        w = base[(i % 5) + 20].split(" ")
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, None), (203, "   \n\t "), (204, "one"), (205, "one two three"), (206, "one two three")]
    rows += [(300, prose(rng, 20_000)), (None, "a text without an id of its own and more words here"), (None, None)]
    rows += [rows[3], rows[3], (201, "")]
    data = [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", len(t) if t else None, 7, 1, True) for i, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, keep_id int, SCORE int, kept boolean"
    ).repartition(5)


@pytest.fixture(scope="session")
def empty(spark, corpus):
    return spark.createDataFrame([], corpus.schema)
