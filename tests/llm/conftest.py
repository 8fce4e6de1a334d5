import random

import pytest

LONG = " ".join(f"word{i % 997}" for i in range(60_000))


def odd_rows():
    """(doc_id, text): nulls, empty, very long, repeated rows, ties, lines in common."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "délta", "ε", "zeta,", "eta.", "theta"]
    rows = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))))
            for k in range(60)]
    shared = "a line that many documents share"
    rows += [(100 + k, f"own text number {k}\n  {shared.upper()} \t\nlast {k}") for k in range(20)]
    rows += [(200, None), (201, ""), (202, " \t "), (203, LONG), (204, LONG + " end"), (None, shared), (None, None),
             (205, "only\n" + shared), (205, "only\n" + shared), (206, "same text of two ids, ten words and more of it"),
             (207, "same text of two ids, ten words and more of it"), (208, "x" * 300_000), (209, "\n" * 5000)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names operators use themselves."""
    rows = [(text, i, f"k{n}", n, "t", None) for n, (i, text) in enumerate(odd_rows())]
    return spark.createDataFrame(rows, "text string, doc_id bigint, key string, n_lines int, id string, print string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
