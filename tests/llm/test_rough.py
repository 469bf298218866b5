"""All queries on empty tables, tables with nulls in every column, repeated rows and extra columns of clashing names."""

import pytest

from conftest import rough
from corpusloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module", params=["empty", "rough"])
def tables(request, tmp_path_factory):
    return request.param, rough(tmp_path_factory.mktemp(request.param), 0 if request.param == "empty" else None)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    kind, d = tables
    n = QUERIES[name](spark, d).count()
    if kind == "empty" and name not in ("p3_shares",):
        assert n == 0


def test_names():
    assert set(ORACLE) <= set(QUERIES) and all(n[0] == "p" and n[2] == "_" for n in QUERIES)
