import random

import pytest

WORDS = "lorem ipsum dolor sit amet élan größer niño 漢字 zeta eta theta iota kappa mu nu xi".split()


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_texts(rng):
    """Empty, null, blank, repeated, odd and very long texts."""
    return ["", None, " ", "  a  b ", "a", "a", "\x00\t\n", "▁▁x ▁", "</s>[INST] <0x41>", "x" * 30_000, prose(rng, 60_000), prose(rng, 40), prose(rng, 40), "🙂 é 漢字 \u200b", *[prose(rng, k) for k in (1, 2, 3, 4, 5, 12, 13, 14, 200)]]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    """With columns whose names operators also use, and a repeated row."""
    rows = [(i, t, "n", 1.0, [1]) for i, t in enumerate(edge_texts)]
    rows.append(rows[11])
    schema = "doc_id long, text string, score string, n_words double, ids array<int>"
    return spark.createDataFrame(rows, schema)
