"""Days that have exactly the hours that windows need, and those that don't."""

from __future__ import annotations

from datetime import date, timedelta

from paneloom.config import SAMPLE
from paneloom.operators import measurement as M

DAY = date(2024, 5, 1)


def hours_of(site, day, *, without=(), again=(), value=30.0):
    """Rows of relative hours 7 to 30 of a day."""
    rels = [*(r for r in range(7, 31) if r not in without), *again]
    return [(site, day + timedelta(days=r // 24), r % 24, value) for r in rels]


def test_hour_checks(spark):
    rows = hours_of("all", DAY) + hours_of("gap", DAY, without=(9, 30)) + hours_of("twice", DAY, without=(8,), again=(12, 12, 7)) + hours_of("none", DAY, value=None)
    rows += hours_of("nan", DAY, without=(7,)) + [("nan", DAY, 7, float("nan"))] + hours_of("inf", DAY, without=(7,)) + [("inf", DAY, 7, float("-inf"))]
    rows += hours_of("odd", DAY) + [("odd", DAY, None, 1.0), ("odd", DAY, 24, 1.0), ("odd", DAY, -1, 1.0)]
    rows += [(None, None, 5, 1.0)]
    hours = spark.createDataFrame(rows, "site string, date_local date, local_hour int, ppb double")
    got = {r["site"]: r for r in M.hour_checks(hours, ["site"], SAMPLE).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {
        "all": "exact", "gap": "missing hour", "twice": "repeated hour", "none": "exact", "nan": "not finite", "inf": "not finite", "odd": "unknown hour", None: "missing hour",
    }
    assert all(r["date_local"] == DAY for k, r in got.items() if k)
    assert got["gap"]["missing"] == [9, 30] and got["twice"]["missing"] == [8] and got["all"]["missing"] == []
    assert got["twice"]["repeated"] == [7, 12] and got["twice"]["n_rows"] == 26
    assert (got["odd"]["n_unknown"], got["odd"]["n_rows"], got["odd"]["repeated"]) == (3, 27, [])
    assert got["nan"]["n_not_finite"] == 1 and got["none"]["n_not_finite"] == 0
    assert M.hour_checks(hours.limit(0), ["site"], SAMPLE).count() == 0
