"""Nearest stations in rings against all pairs, and names of several regions in logistic fits."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd

from paneloom.operators import geography, logistic


def test_rings_find_what_all_pairs_do(spark):
    """Near sites with few days in common go on to wider rings, at any latitude; a site without any has no row."""
    rng = np.random.default_rng(3)
    lat, lon = np.array([30.0, 48.0, 75.0, 86.0, 60.0]), np.array([0.0, 10.0, 20.0, 30.0, -150.0])
    sites = pd.DataFrame({"site": np.arange(5), "site_lat": lat, "site_lon": lon})
    at = np.repeat(np.arange(4), 60)
    stations = pd.DataFrame({"station": np.arange(240), "station_lat": lat[at] + rng.uniform(-1.5, 1.5, 240), "station_lon": lon[at] + rng.uniform(-1.5, 1.5, 240) / np.cos(np.radians(lat[at]))})
    day = datetime.date(2020, 1, 1)
    site_days = pd.DataFrame([(s, day + datetime.timedelta(int(k))) for s in range(5) for k in range(100)], columns=["site", "date_local"])
    station_days = pd.DataFrame([(s, day + datetime.timedelta(int(k))) for s in range(240) for k in rng.integers(0, 100, 1 + s % 7)], columns=["station", "date_local"])
    frames = [spark.createDataFrame(x) for x in (sites, stations, site_days, station_days)]
    for least in (0.01, 0.05, 0.065):
        expected = geography.nearest(geography.overlap(geography.near_stations(frames[0], frames[1], 150.0), frames[2], frames[3]), least).toPandas()
        got = geography.nearest_in_rings(frames[0], frames[1], 150.0, frames[2], frames[3], least).toPandas()
        assert sorted(map(tuple, got.round(9).values)) == sorted(map(tuple, expected.round(9).values))
    assert len(expected) < 5


def test_a_name_in_two_regions_is_a_site_of_each(spark):
    """Logistic fits join rows and effects by region and name, so that rows do not multiply."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame([(r, s, x, float(rng.random() < 1 / (1 + np.exp(-x)))) for r in "RQ" for s in ("a", "b") for x in rng.normal(size=40)], columns=["climate_region", "site_id", "x", "y"])
    got = logistic.fit(logistic.varying_sites(spark.createDataFrame(rows), "y"), ["x"], "y").toPandas()
    other = logistic.fit(spark.createDataFrame(rows.assign(site_id=rows.climate_region + rows.site_id)), ["x"], "y").toPandas()
    assert len(got) == 4 and np.allclose(sorted(got.alpha), sorted(other.alpha), atol=1e-7)
