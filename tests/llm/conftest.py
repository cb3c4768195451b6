import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rep string, bucket double, kept string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, odd white space, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    base = prose(rng, 120).split()
    for _ in range(12):
        words = base[:]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "x" * rng.randint(1, 5)
        texts.append(" ".join(words))
    texts += [texts[0], texts[0] + "  ", texts[0].replace(" ", "\n"), texts[1], texts[1].upper(), None, "", " \t\n", None, "word", "one two three four", "One two three four"]
    texts += ["é日本 ß’s don't  x y 1234 " * 30, "a" * 3000, prose(rng, 9000), "!!! ??? $$$ " * 40, "the same line\n" * 30]
    out = [(i * 3 % 101, t, "en", ("a", "b", None, "c")[i % 4] if i % 3 else "a", len(t or ""), 1, "r", 0.5, "k") for i, t in enumerate(texts)]
    return out + [(None, "no id here at all", "en", "a", 3, 1, "r", 0.5, "k"), out[5]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(bool(r[1]) and "$" not in r[1]), int(r[0] is not None and r[0] % 7 == 0)) for r in rows], "doc_id long, quality int, toxic int")
