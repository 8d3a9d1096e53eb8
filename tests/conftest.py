import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oreline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def lcg(seed):
    """The generator of the fixtures: s = (s * 1664525 + 1013904223) mod 2^32, value s / 2^32."""
    while True:
        seed = (seed * 1664525 + 1013904223) % 2**32
        yield seed / 2**32


@pytest.fixture(scope="session")
def class_rows(spark):
    r, rows = lcg(12345), []
    for i in range(300):
        income, age, loan = round(1000 + next(r) * 9000, 2), int(20 + next(r) * 40), round(next(r) * 5000, 2)
        rows.append((i, income, age, loan, "SNL"[int(next(r) * 3)], int(income > 5000 and age > 30)))
    return spark.createDataFrame(rows, "id bigint, renda double, idade int, emprestimo double, regiao string, diagnostico int")


@pytest.fixture(scope="session")
def reg_rows(spark):
    r, rows = lcg(999), []
    for i in range(200):
        a, b = next(r) * 10, next(r) * 10
        rows.append((i, a, b, 2 * a + 3 * b + next(r)))
    return spark.createDataFrame(rows, "id bigint, x1 double, x2 double, zona double")


@pytest.fixture(scope="session")
def sql_rows(spark):
    rows = [(i, 1000 + (i % 10) * 500, "SNL"[i % 3], 20 + i % 40, i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "id int, renda int, regiao string, idade int, diag int")
