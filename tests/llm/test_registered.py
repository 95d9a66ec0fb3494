"""Every registered operator has SQL stating its result, or a test that compares it with a plain version."""

import pathlib

import compare
import pytest

from veilwork.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare.problems(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_is_tested(name):
    here = pathlib.Path(__file__)
    others = [p.read_text() for p in here.parent.glob("test_*.py") if p != here]
    assert any(f'QUERIES["{name}"]' in text for text in others)


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(ORACLES) <= set(QUERIES)
