"""Small hostile documents: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

KINDS = "doc_id long, text string, id long, th string, n_lines string, w string"


def texts():
    rng = random.Random(5)
    pool = [f"{a}{b}" for a in ("ka", "Lo", "mé", "ñu", "ti") for b in ("ra", "no", "ße", "s", "x9")]
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    base = [prose(rng.randint(1, 60)) for _ in range(40)]
    base += [f"A shared line of text.\n  {prose(9)}\n\na SHARED line of text.  ", f"x\na shared line of text.\n{prose(30)}", base[3], base[3], base[3] + " end", "", " \n\t ", None, None]
    base += [prose(3000), "\n" * 50, "!! ?? --", base[5].upper(), "one two", "ÀÉ\x00ß \x0b a\x0cb\r\n c"]
    return base


@pytest.fixture(scope="session")
def rows():
    out = [(i, t) for i, t in enumerate(texts())]
    return [*out, out[3], (7, "another text of seven"), (None, out[3][1]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "th", "z", "w") for i, t in rows], KINDS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KINDS)
