import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rest string, score int"


def prose(seed, n):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs, empty and long texts, ties, repeated rows and ids, odd spaces."""
    same = prose(1, 60)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None),
        (4, same, "en", "a"), (5, same, "de", "b"), (5, same, "de", "b"), (6, same + " more", "en", None),
        (7, prose(2, 9000), "en", "a"), (8, "12 34 .. !! 77", "en", "b"), (9, "Été 中文 \U0001d54f ok", "fr", "b"),
        (10, "line one is here\nline one is here\n\nline one is here", "en", "c"),
        (11, "mail a.b+c@x-y.example.org, or +1 (212) 555-0199 and 4111 1111 1111 1111.", "en", "c"),
        (12, " ".join(["The"] * 400), "en", "c"), (-13, prose(3, 40), None, "~"), (14, "one", "en", "="),
        (15, "no\xa0break space here", "en", "b"), (16, prose(4, 30), "en", ""),
    ]
    return [(i, t, la, s, None if t is None else len(t), "clash", 7) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
