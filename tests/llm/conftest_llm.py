"""A small corpus with nulls, empty and long texts, ties, repeated rows and copies."""

import random

import pytest

WORDS = ["river", "stone", "lamp", "cloud", "paper", "green", "walks", "over", "under", "the", "of", "and", "to", "a", "bird", "sings", "winter", "is", "near", "house"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "x", "ing", "ly"])) for _ in range(n))


BENCH = [(1, prose(900, 24)), (2, "Only Six Words Are In Here"), (3, None), (4, ""), (10, prose(901, 12)), (1, prose(902, 11))]


def corpus() -> list[tuple]:
    rows = [(i, prose(i, 30 + 7 * (i % 9))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[8][1] + " tail"), (103, None), (104, ""), (105, "  \n\t "), (106, "one"), (107, "one two")]
    rows += [(108, prose(5, 9000)), (109, "pre " + BENCH[0][1] + " post"), (110, prose(7, 40) + "\n" + BENCH[0][1][:90] + "\n" + BENCH[4][1].upper()), (111, "x only, six words: are in HERE y")]
    rows += [(None, "no id here at all"), (60, prose(60, 40)), (60, prose(60, 40)), (112, "same line\nsame line\n\nsame line\n| | & <b>"), (113, (prose(13, 9) + " ") * 5), (114, "é ÀB ß 日本 \x1c x")]
    return [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(corpus(), schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
