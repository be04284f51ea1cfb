import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, n_words string, score string, toxic string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, short, long, empty and null texts, repeated rows, nulls in every column, clashing names."""
    rng = random.Random(7)
    out, base = [], [words(rng, 60) for _ in range(4)]
    for i in range(60):
        tokens = base[i % 4].split()
        for _ in range(rng.randrange(5)):
            tokens[rng.randrange(len(tokens))] = f"x{rng.randrange(50)}"
        out.append((i, " ".join(tokens), "en", f"s{i % 3}"))
    out += [(100 + i, base[0], "en", "s0") for i in range(5)]
    out += [(200, "", "en", "s1"), (201, None, None, None), (202, "one", "en", "s1"), (203, "ONE", "en", "s1"), (204, " \t\n ", "en", None), (205, words(rng, 30_000), "en", "s2"), (206, "Ünï ©ode 漢字 \U0001f600 a b c", "fr", "é")]
    out += [(300, "same row twice here now", "en", "s0")] * 3 + [(None, "a null id has this text", "en", "s0"), (None, "a null id has this text", "en", "s0"), (None, None, None, None)]
    return [(i, t, lang, s, None if t is None else len(t), "their size", "their shard", "their words", "their score", "their label") for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
