"""Every registered query of the panel against its SQL oracle."""

from __future__ import annotations

import pytest

from oracle import SF, canonical, connection
from paneloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
#: Queries on rows with common support, of which the smallest tables have none.
LARGER = "/root/testdata/sf0.01"
FITS = {
    "abcd_linear", "s1c_population", "s1c_linear", "s1c_bootstrap", "leverage_linear", "leverage_regions", "fe_slope_by_region", "bootstrap_decomposition", "bootstrap_supported", "sensitivity_comparison", "region_diagnostics", "paired_bootstrap", "resumed_bootstrap", "fit_classes", "verified_fit",
}


@pytest.fixture(scope="module")
def duck():
    return {sf: connection(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    sf = LARGER if name in FITS else SF
    got = QUERIES[name](spark, sf).toPandas()
    expected = duck[sf].execute(ORACLES[name]).fetchdf()
    assert len(got) or name not in FITS
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
