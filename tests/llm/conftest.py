import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(20_000))


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(("th", "en", "or", "ly", "sch", "ung", "é")) * rng.randint(1, 2)
                    + rng.choice("abcdef") for _ in range(n))


def rows() -> list[tuple]:
    """Small documents with nulls, empties, copies, repeated rows, a long text and a shared passage."""
    passage = prose(999, 40)
    made = [(i, prose(i, 30 + 7 * i), "en" if i % 2 else "de", "s", 1) for i in range(1, 12)]
    made += [(20 + i, f"{prose(100 + i, 12)} {passage}\n{prose(200 + i, 9)}", "en", "s", 1) for i in range(4)]
    made += [(30, prose(3, 51), None, None, None), (31, prose(3, 51), "en", "s", 1)]
    near = prose(4, 400).split()
    near[7] = "changed"
    made += [(40, prose(4, 400), "en", "s", 1), (41, " ".join(near), "en", "s", 1)]
    made += [(50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, " \n\t ", "en", None, 3)]
    made += [(53, "12 34 !!", "de", "s", 8), (54, "Word", "de", "s", 4), (55, LONG, "en", "s", 9)]
    made += [(20, made[11][1], "en", "s", 1), (None, "no id at all here", "en", "s", 1), (None, None, None, None, None)]
    return made


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("score", "block", "id", "fp", "component_id", "lang_pred", "kept", "spans")
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
