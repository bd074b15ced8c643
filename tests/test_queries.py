"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests import compare

FOLDER = f"{compare.DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", compare.entry.queries())
def test_query(spark, duck, name):
    verdict, _ = compare.compare(spark, duck, name, FOLDER)
    assert verdict.startswith(("same", "rows only")), verdict


def test_entry(spark):
    assert compare.entry.entry(spark).columns == ["run_id", "task_id", "n_dependencies"]


def test_no_sql_without_query():
    assert set(compare.entry.oracle_sql()) <= set(compare.entry.queries())
