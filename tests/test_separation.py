"""Separation along a direction of several columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.operators import audits, separation


def frame(seed, n=160, p=2):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({f"x{i}": rng.normal(size=n) for i in range(p)})
    rows["site_id"] = [f"s{i % 8}" for i in range(n)]
    rows["climate_region"] = ["RQ"[i % 8 > 4] for i in range(n)]
    return rows


def found(spark, rows, xs):
    return {r["climate_region"]: r["separation"] for r in separation.separation(spark.createDataFrame(rows), xs, "y").collect()}


def test_directions_that_no_single_column_shows(spark):
    rows = frame(1)
    # Sites have thresholds of their own, so no line without site effects does it.
    own = rows.site_id.str[1].astype(int)
    along = rows.x0 - 0.7 * rows.x1
    rows["y"] = (along > 0.3 * own - 1).astype(int)
    rows.loc[rows.climate_region == "Q", "y"] = (np.random.default_rng(9).random((rows.climate_region == "Q").sum()) < 0.5).astype(int)
    assert found(spark, rows, ["x0", "x1"]) == {"R": "complete", "Q": "none"}
    for x in ("x0", "x1"):
        assert {r["climate_region"]: r["separation"] for r in audits.separation(spark.createDataFrame(rows), x, "y").collect()}["R"] == "none"


def test_border_and_one_overlap(spark):
    rows = frame(2, p=3)
    along = rows.x0 + 2 * rows.x1 - rows.x2
    rows["y"] = (along > 0).astype(int)
    level = rows[rows.climate_region == "R"].groupby("site_id").head(2).index
    rows.loc[level, "x2"] = rows.x0[level] + 2 * rows.x1[level]
    rows.loc[level, "y"] = np.arange(len(level)) % 2
    assert found(spark, rows, ["x0", "x1", "x2"]) == {"R": "quasi", "Q": "complete"}
    worst = rows[(rows.climate_region == "Q") & (rows.y == 0)].index[0]
    rows.loc[worst, "x0"] += 50
    assert found(spark, rows, ["x0", "x1", "x2"])["Q"] == "none"


def test_columns_without_variation_and_sites_of_one_outcome(spark):
    rows = frame(3)
    rows["same"], rows["twice"] = 1.0, 2 * rows.x0
    rows["y"] = (rows.x0 > 0).astype(int)
    rows.loc[rows.site_id == "s1", "y"] = 1
    rows.loc[rows.climate_region == "Q", "y"] = 0
    got = {r["climate_region"]: r for r in separation.separation(spark.createDataFrame(rows), ["x0", "same", "twice"], "y").collect()}
    assert (got["R"]["separation"], got["R"]["matrix_rank"], got["R"]["all_one_sites"], got["R"]["varying_sites"]) == ("complete", 1, 1, 4)
    assert (got["Q"]["separation"], got["Q"]["all_zero_sites"]) == ("no site varies", 3)
    assert separation.separation(spark.createDataFrame(rows).limit(0), ["x0"], "y").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_as_one_column_is_judged(spark, seed):
    rng = np.random.default_rng(seed)
    rows = frame(seed, n=48, p=1)
    rows["x0"] = rows.x0.round(1)
    rows["y"] = (rows.x0 + (0.0, 0.02, 1.0)[seed] * rng.normal(size=len(rows)) > 0).astype(int)
    expected = {r["climate_region"]: r["separation"] for r in audits.separation(spark.createDataFrame(rows), "x0", "y").collect()}
    assert found(spark, rows, ["x0"]) == expected


def test_point_of_least_norm():
    rng = np.random.default_rng(0)
    for shift in (0.0, 3.0):
        points = rng.normal(size=(40, 3)) + shift
        z, some, weights = separation.least_norm(points)
        assert np.allclose(weights @ points[some], z) and weights.min() > 0 and weights.sum() == pytest.approx(1)
        assert (points @ z >= z @ z - 1e-9).all()
        assert (np.linalg.norm(z) < 1e-7) == (shift == 0.0)


def test_spread_over_partitions(spark):
    rows = frame(5)
    rows["y"] = (rows.x0 + rows.x1 > 0).astype(int)
    df = spark.createDataFrame(rows).repartition(9, F.rand(1))
    assert {r["separation"] for r in separation.separation(df, ["x0", "x1"], "y").collect()} == {"complete"}
