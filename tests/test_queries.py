"""Registered queries against their SQL oracles, and checks of the registry itself."""
from __future__ import annotations

import pytest
from conftest import SMALL
from oracle_check import compare, duck, duck_rows, spark_rows

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert compare(spark_rows(QUERIES[name](spark, SMALL)), duck_rows(con, ORACLES[name])) is None


FAMILIES = {"s": 12, "c": 18, "v": 12, "f": 20, "l": 3, "e": 13, "m": 12, "p": 16, "g": 12, "x": 7, "r": 3, "q": 16}
#: Checked without a registered query: types and emptiness raise, they give no rows.
UNREGISTERED = {"v01", "v02"}


def test_registry():
    """Every operator has a query; a name covers its ids and, of two ids of one family, those between."""
    assert set(ORACLES) <= set(QUERIES)
    covered = set()
    for name in QUERIES:
        ids = [p for p in name.split("_") if len(p) == 3 and p[0] in FAMILIES and p[1:].isdigit()]
        for letter in {i[0] for i in ids}:
            numbers = [int(i[1:]) for i in ids if i[0] == letter]
            covered |= {f"{letter}{n:02d}" for n in range(min(numbers), max(numbers) + 1)}
    wanted = {f"{letter}{n:02d}" for letter, most in FAMILIES.items() for n in range(1, most + 1)}
    assert wanted - covered - UNREGISTERED == set()
    numbered = {name.split("_")[0] for name in QUERIES if name.startswith("op")}
    assert numbered in (set(), {f"op{n}" for n in range(1, 14)}) and ("pipeline" in QUERIES) == bool(numbered)


def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() > 0 and "churn_rate" in out.columns
