"""Every registered telemetry query against its DuckDB oracle."""

from __future__ import annotations

import pytest
from compare import duck, rows

from plantlens.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    names, want = duck(sf, ORACLES[name])
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, frame.collect()) == rows(names, want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
