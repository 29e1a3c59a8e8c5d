import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, cls string, digest string, keep_id string, k string, start string, sequence_id string"


def made_rows():
    """Nulls, empty and blank texts, long ones, ties, repeated rows and near copies."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, base = prose(12_000), prose(200).split()
    near = [*base[:-3], "other", "words", "here"]
    mail = "Write to jane.doe@mail.example.com or call +44 20 7946 0958 from 192.168.0.254, card 4111 1111 1111 1111."
    texts = [
        (None, prose(30)), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "x" * 40_000), (6, " ".join(base)), (6, " ".join(base)),
        (7, " ".join(near)), (8, " ".join(base).upper()), (9, mail), (10, mail), (-3, mail), (20, "ÀÉ naïve façade 漢字 🙂 don't we'll 12345  \n\n x"),
        (40, "<|endoftext|> and <|startoftext|> inside"), (60, long + " tail"), (80, "one two"), (81, "one two"), (100, "one two three\x1cfour"), (None, "one two"),
    ]
    return [(d, t, None, "s", None if t is None else len(t), "a", "b", "c", "d", "e", "f", "g") for d, t in texts]


@pytest.fixture(scope="session")
def made(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)


@pytest.fixture(scope="session")
def marks(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
