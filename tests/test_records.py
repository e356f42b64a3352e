"""Canonical records with digests, and the order of reports."""

from __future__ import annotations

import hashlib
import json

import pytest

from paneloom.operators import descriptive as D
from paneloom.operators.tables import recorded


def test_records(spark):
    rows = [("b", None, 7, True, [2, 1]), (None, 'say "é"', -1, False, []), ("b", None, 7, True, [2, 1]), ("", "\n", 0, None, None)]
    df = spark.createDataFrame(rows, "z string, a string, `m.n` long, flag boolean, xs array<int>")
    got = recorded(df).collect()
    assert len(got) == 4
    for r in got:
        plain = {k: r[k] for k in ("z", "a", "m.n", "flag", "xs")}
        text = json.dumps(plain, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r["record"] == text and r["sha256"] == hashlib.sha256(text.encode()).hexdigest()
    # Columns in another order give the same, and records are not part of themselves.
    again = recorded(recorded(df.select("xs", "flag", "`m.n`", "a", "z"))).collect()
    assert sorted(r["sha256"] for r in again) == sorted(r["sha256"] for r in got)
    assert recorded(df, "z", "a").first()["record"] == '{"a":null,"z":"b"}'
    assert recorded(df.limit(0)).count() == 0
    with pytest.raises(TypeError, match="share"):
        recorded(df.selectExpr("z", "0.5D as share"))


def test_the_nation_comes_first(spark):
    rows = [("South", "later"), ("national", "later"), ("Alaska", "early"), ("zone", "early"), ("national", "early"), (None, "early"), ("South", "early")]
    got = D.in_order(spark.createDataFrame(rows, "scope string, period string"), "period").collect()
    found = [(r["scope"], r["period"]) for r in sorted(got, key=lambda r: r["place"])]
    assert [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(7))
    assert found == [("national", "early"), ("national", "later"), (None, "early"), ("Alaska", "early"), ("South", "early"), ("South", "later"), ("zone", "early")]
    assert D.in_order(spark.createDataFrame([], "scope string, period string")).count() == 0
