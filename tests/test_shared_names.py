"""Queries against their SQL where suppliers' keys have more than four digits, so that suppliers of several regions share a site's name."""

from __future__ import annotations

import os

import duckdb
import pytest

from oracle import canonical, connection
from paneloom.plans import registry

SOURCE = "/root/testdata/sf0.01"
#: Three suppliers for each: with its own key, and in two groups of ten that share a name.
KEY = "CASE k WHEN 0 THEN {0} WHEN 1 THEN 10000 + {0} ELSE 10500 + {0} END"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    out = tmp_path_factory.mktemp("shared-names")
    c = duckdb.connect()
    for name, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
        c.execute(f"COPY (SELECT b.* REPLACE ({KEY.format(key)} AS {key}) FROM '{SOURCE}/{name}.parquet' b, (SELECT unnest(range(3)) AS k)) TO '{out}/{name}.parquet'")
    for name in ("region", "nation", "customer", "part", "orders", "events"):
        os.symlink(f"{SOURCE}/{name}.parquet", f"{out}/{name}.parquet")
    return str(out)


NAMES = """
abcd_linear bootstrap_decomposition bootstrap_first_replicates bootstrap_interval_ranks bootstrap_intervals burden_bootstrap burden_records candidate_filters candidate_populations completeness
continuous_vs_threshold decomposition_descriptors descriptive_checks row_weighted_vs_equal_site bootstrap_supported bootstrap_failures s1c_linear s1c_bootstrap leverage_regions
""".split()


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tables, name):
    got = registry.queries()[name](spark, tables).toPandas()
    expected = connection(tables).execute(registry.oracle_sql()[name]).fetchdf()
    assert len(got) and sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)
