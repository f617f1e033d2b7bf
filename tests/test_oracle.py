"""Every registered query next to its DuckDB statement on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

from cuespark.plans.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, note = check.compare(spark, con, sf_dir, name)
    assert ok, note


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
