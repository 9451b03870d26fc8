import random

import pytest

EDGES = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    (6, "one two"),
    (6, "one two"),
    (7, "  one\ttwo \n"),
    (None, "one two"),
    (8, "é " * 3 + "naïve 中文 \U0001f642 \x00 x=1"),
    (9, "repeat " * 400),
    (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"),
    (12, "one"),
    (11, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron rho"),
]
EXTRA = ", key string, n long, node string, marks int, kept string, part int, leaf string, term string, n_tokens string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with the operators' own names."""
    rows = [(i, t, "k", 1, "x", 2, "y", 3, "l", "t", "u") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{min(r.randrange(vocabulary), r.randrange(vocabulary))}" for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Plain documents with copies, near copies, shared passages and frequent words: [(doc_id, text)]."""
    r = random.Random(11)
    docs = [(i, prose(i, r.choice([3, 20, 60, 200]))) for i in range(40)]
    passage = prose(1000, 40)
    for i in range(40, 70):
        docs.append((i, prose(i, 30) + " " + passage + "\n" + prose(i + 500, 15)))
    base = prose(2000, 80).split()
    for i in range(70, 95):
        w = list(base)
        w[r.randrange(80)] = f"v{i}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, docs[5][1]) for i in range(6)] + [(110, "the " * 300), (111, "the " * 290 + "end")]
    return docs
