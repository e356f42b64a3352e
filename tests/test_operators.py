"""Hand-written cases for the panel operators."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.config import PanelConfig
from paneloom.functions import columns as C
from paneloom.functions import splines
from paneloom.operators import audits, bootstrap, compare, descriptive, geography, logistic, measurement, population, regression, replicates, seasons, tables, vectors

CFG = PanelConfig()


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(69.9999,), (70.0,), (70.0001,), (-3.0,)], "y double")
    assert [r[0] for r in rows.select(C.elevated(F.col("y"), 70.0)).collect()] == [False, False, True, False]


@pytest.mark.parametrize(("day", "expected"), [(date(2020, 2, 29), None), (date(2020, 3, 1), 60), (date(2020, 12, 31), 365), (date(2021, 3, 1), 60), (date(1900, 3, 1), 60)])
def test_calendar_day(spark, day, expected):
    assert one(spark, d=day).select(C.calendar_day_365(F.col("d"))).first()[0] == expected


def test_bins_and_truncation(spark):
    row = one(spark, t=-0.1, ppm=0.0709).select(C.temperature_bin(F.col("t"), 2.0), C.truncated_ppb(F.col("ppm"))).first()
    assert row[0] == -2.0 and row[1] == 70


def test_season_over_the_years_end(spark):
    days = spark.createDataFrame([(date(2020, 11, 1),), (date(2020, 2, 28),), (date(2020, 2, 29),), (date(2020, 7, 1),)], "d date")
    assert [r[0] for r in days.select(C.in_season(F.col("d"), F.lit(1101), F.lit(228))).collect()] == [True, True, False, False]


def test_hour_of_the_next_morning_belongs_to_the_day_before(spark):
    row = one(spark, d=date(2020, 1, 2), h=6).select(C.target_day(F.col("d"), F.col("h")), C.relative_hour(F.col("h"))).first()
    assert row[0] == date(2020, 1, 1) and row[1] == 30


def test_first_failing_rule_wins(spark):
    rows = one(spark, unit="ppb", method="x")
    rules = [("units", F.col("unit") != "ppm"), ("method", F.col("method") == "x")]
    found = measurement.classified(rows, rules)
    assert found.first()["reason"] == "units"
    assert measurement.ledger(found).first()["n_rows"] == 1


HOUR = "site int, date_local date, local_hour int, poc string, ppb double"
D1 = date(2020, 1, 1)


@pytest.mark.parametrize(
    ("pocs", "verdict", "ppb", "duplicates"),
    [([("1", 5.0), ("1", 6.0), ("2", 7.0)], "keep", 7.0, 2), ([("1", 5.0), ("2", 7.0)], "ambiguous", None, 0), ([("1", 5.0), ("1", 5.0)], "missing", None, 2)],
)
def test_monitor_resolution(spark, pocs, verdict, ppb, duplicates):
    rows = spark.createDataFrame([(1, D1, 9, p, v) for p, v in pocs], HOUR)
    got = measurement.resolve_monitors(rows, ["site", "date_local", "local_hour"]).first()
    assert (got["verdict"], got["ppb"], got["duplicate_rows"]) == (verdict, ppb, duplicates)


def windows(spark, hours):
    rows = spark.createDataFrame([(1, D1, h, v) for h, v in hours], "site int, date_local date, local_hour int, ppb double")
    return measurement.daily_windows(rows, "site", CFG).first()


def test_windows_need_six_hours_and_days_thirteen_windows(spark):
    full = windows(spark, [(h, float(h)) for h in range(7, 24)])
    assert full["valid_windows"] == 12 and full["mda8"] is None
    more = spark.createDataFrame([(1, D1, h, float(h)) for h in range(7, 24)] + [(1, date(2020, 1, 2), 0, 50.9)], "site int, date_local date, local_hour int, ppb double")
    got = measurement.daily_windows(more, "site", CFG).first()
    assert got["valid_windows"] == 13 and got["mda8"] == 25.0  # hours 19 to 24


def test_window_without_its_first_hour_counts(spark):
    assert windows(spark, [(h, 10.0) for h in range(8, 15)])["valid_windows"] == 3  # starts at 7, 8 and 9


def test_episodes_return(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate("ABAA")] + [(2, 0, None), (2, 1, None), (2, 2, "A")], "site int, day int, c string")
    got = {(r["site"], r["day"]): r["episode"] for r in geography.episodes(rows, "site", ["day"], ["c"]).collect()}
    assert [got[1, i] for i in range(4)] == [1, 2, 3, 3] and [got[2, i] for i in range(3)] == [1, 1, 2]


def test_grid_join_finds_what_all_pairs_find(spark):
    rng = np.random.default_rng(1)
    a = pd.DataFrame({"site": range(30), "site_lat": rng.uniform(25, 49, 30), "site_lon": rng.uniform(-120, -70, 30)})
    b = pd.DataFrame({"station": range(300), "station_lat": rng.uniform(25, 49, 300), "station_lon": rng.uniform(-120, -70, 300)})
    sa, sb = spark.createDataFrame(a), spark.createDataFrame(b)
    got = {(r["site"], r["station"]) for r in geography.near_stations(sa, sb, 120.0).collect()}
    d = C.haversine_km(F.col("site_lat"), F.col("site_lon"), F.col("station_lat"), F.col("station_lon"))
    assert got == {(r["site"], r["station"]) for r in sa.crossJoin(sb).where(d <= 120.0).collect()} and got


def test_equally_near_stations_give_the_smaller(spark):
    rows = spark.createDataFrame([(1, 9, 5.0, 1.0), (1, 3, 5.0, 0.95), (1, 1, 4.0, 0.5)], "site int, station int, distance_km double, overlap_fraction double")
    assert geography.nearest(rows, 0.9).first()["station"] == 3


def test_most_specific_season_rule(spark):
    rules = spark.createDataFrame([("R", "", "", 101, 131), ("R", "N", "", 201, 228), ("R", "N", "s1", 301, 331)], "rule_region string, rule_nation string, rule_site string, begin int, end int")
    sites = spark.createDataFrame([("s1", "R", "N"), ("s2", "R", "N"), ("s3", "R", "M"), ("s4", "Q", "M")], "site_id string, climate_region string, nation string")
    got = {r["site_id"]: (r["begin"], r["scope"]) for r in seasons.resolve(sites, rules).collect()}
    assert got == {"s1": (301, "site"), "s2": (201, "nation"), "s3": (101, "region"), "s4": (None, None)}


def test_support_needs_both_periods(spark):
    rows = spark.createDataFrame([("s", "R", p, 1.0) for p, n in (("early", 30), ("later", 29)) for _ in range(n)], "site_id string, climate_region string, period string, tmax_c double")
    assert not population.support_counts(rows, CFG).first()["supported"]


def test_quality_year_goes_whole(spark):
    rows = spark.createDataFrame([("a", 2025, "Y"), ("a", 2025, None), ("b", 2025, "Y"), ("a", 2024, None)], "site_id string, calendar_year int, cert string")
    got = {(r["site_id"], r["calendar_year"]) for r in population.whole_quality_years(rows, CFG, F.col("cert") == "Y").collect()}
    assert got == {("b", 2025), ("a", 2024)}


def test_identity_ignores_order(spark):
    rows = spark.range(100).withColumn("s", F.col("id").cast("string"))
    a, b = (population.identity(r, "id", "s").first() for r in (rows, rows.orderBy(F.rand(3)).repartition(7)))
    assert a == b


def test_places_and_names(spark):
    numbered = spark.createDataFrame([(i, f"s{i % 3}", float(i)) for i in range(9)], "panel_row long, site_id string, y double")
    places = spark.createDataFrame([(7,), (2,), (2,)], "panel_row long")
    assert sorted(tuple(r) for r in population.gathered(numbered, places, "y").collect()) == [(2, 2.0), (2, 2.0), (7, 7.0)]
    with pytest.raises(Exception, match="outside the panel"):
        population.gathered(numbered, spark.createDataFrame([(99,)], "panel_row long"), "y").collect()
    a, b, c = (population.named_identity(rows, name, "site_id", "y").first() for rows, name in ((numbered, "x"), (numbered.repartition(5, "y"), "x"), (numbered, "z")))
    assert a == b and a["sha256"] != c["sha256"] and a["n_rows"] == 9


def test_equal_site_and_pooled_shares(spark):
    rows = [("a", "NE", "early", 71.0)] + [("a", "NE", "early", 60.0)] + [("b", "NE", "early", 60.0)] * 4 + [(s, "NE", "later", 60.0) for s in "ab"]
    frame = spark.createDataFrame(rows, "site_id string, climate_region string, period string, ozone_mda8_ppb double")
    got = descriptive.exceedance(descriptive.paired(descriptive.site_periods(frame, 70.0))).where("scope = 'NE' and period = 'early'").first()
    assert got["equal_site_share"] == 0.25 and got["row_weighted_share"] == pytest.approx(1 / 6)


def test_deciles_are_equal_cuts(spark):
    rows = spark.createDataFrame([(i, float(i // 2)) for i in range(23)], "i int, v double")
    got = descriptive.fitted_deciles(rows, "v", "i").toPandas().sort_values("i")["decile"].tolist()
    expected = (pd.qcut(pd.Series([float(i // 2) for i in range(23)]).rank(method="first"), 10, labels=False) + 1).tolist()
    assert got == expected


def test_fixed_effects_match_dense_least_squares(spark):
    rng = np.random.default_rng(0)
    n = 400
    frame = pd.DataFrame({"site_id": [f"s{i % 7}" for i in range(n)], "climate_region": "R", "x1": rng.normal(size=n), "x2": rng.normal(size=n)})
    frame["y"] = 2 * frame.x1 - frame.x2 + frame.site_id.str[1].astype(int) + rng.normal(size=n)
    fit = regression.fit(spark.createDataFrame(frame).repartition(5), ["x1", "x2"], "y").toPandas()
    dense = np.column_stack([pd.get_dummies(frame.site_id).to_numpy(float), frame[["x1", "x2"]]])
    beta, rss, *_ = np.linalg.lstsq(dense, frame.y, rcond=None)
    assert np.allclose(fit["beta"][0], beta[-2:], atol=1e-12)
    assert np.allclose(fit.sort_values("site_id")["alpha"], beta[:-2], atol=1e-12)
    assert fit["rss"][0] == pytest.approx(float(rss[0]))


def test_logit_matches_dense_newton(spark):
    rng = np.random.default_rng(4)
    n = 900
    frame = pd.DataFrame({"site_id": [f"s{i % 5}" for i in range(n)], "climate_region": "R", "x": rng.normal(size=n)})
    frame["y"] = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * frame.x + 0.3 * frame.site_id.str[1].astype(int) - 0.5)))).astype(float)
    got = logistic.fit(spark.createDataFrame(frame).repartition(4), ["x"], "y").toPandas().sort_values("site_id")
    dense = np.column_stack([pd.get_dummies(frame.site_id).to_numpy(float), frame.x])
    b = np.zeros(6)
    for _ in range(20):
        p = 1 / (1 + np.exp(-dense @ b))
        b += np.linalg.solve(dense.T @ (dense * (p * (1 - p))[:, None]), dense.T @ (frame.y - p))
    assert np.allclose(got["alpha"], b[:5], atol=1e-9) and np.allclose(got["beta"].iloc[0], b[5:], atol=1e-9)
    separated = frame.assign(y=(frame.x > 0).astype(float))
    with pytest.raises(ValueError):
        logistic.fit(spark.createDataFrame(separated), ["x"], "y")


def test_refits_equal_fits_of_copied_rows(spark):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame([(f"s{s}", "R", p, float(t), s + (p == "later") * 2 + 0.5 * t + rng.normal()) for s in range(4) for p in ("early", "later") for t in rng.integers(0, 20, 15)], columns=["site_id", "climate_region", "period", "tmax_c", "y"])
    df = spark.createDataFrame(rows).withColumn("later", (F.col("period") == "later").cast("double"))
    design = regression.Design("later", ("tmax_c",))
    drawn = spark.createDataFrame([(1, "R", s, f"{s}-{i}", i) for i, s in enumerate(["s0", "s0", "s2", "s3"])], bootstrap.DRAWS)
    got = regression.refit(drawn, regression.site_vectors(df, design, "y"), design, 0.0, 1.0).first()
    copied = bootstrap.materialised(drawn, df)
    with_r, xs = design.columns(copied)
    expected = regression.site_means(copied, regression.fit(with_r, xs, "y"), design, 0.0, 1.0).agg(*[F.avg(c).alias(c) for c in "ABCD"]).first()
    assert all(got[c] == pytest.approx(expected[c], abs=1e-9) for c in "ABCD") and got["n_sites"] == 4


def test_rebuilt_replicates_equal_fits_of_copied_rows(spark):
    """Support, knots, bases and fit of a replicate against those of rows that are copied."""
    rng = np.random.default_rng(6)
    rows = pd.DataFrame(
        [(f"s{s}", "RQ"[s > 4], p, float(t), int(d), s + (p == "later") * 2 + 0.3 * t + np.sin(d / 60) + rng.normal()) for s in range(9) for p in ("early", "later") for t, d in zip(rng.integers(0, 30, 60), rng.integers(1, 366, 60), strict=True)],
        columns=["site_id", "climate_region", "period", "tmax_c", "day_of_year", "y"],
    )
    rows["day_of_year"] = rows["day_of_year"].astype("int32")
    df = spark.createDataFrame(rows).withColumns({"later": (F.col("period") == "later").cast("double"), "bin": C.temperature_bin(F.col("tmax_c"), 5.0)})
    drawn = spark.createDataFrame([(k, "RQ"[i > 4], f"s{s}", f"{k}-{i}", i) for k, names in ((1, [0, 0, 2, 3, 4, 5, 5, 8, 7]), (2, [1, 1, 1, 2, 0, 6, 7, 8, 5])) for i, s in enumerate(names)], bootstrap.DRAWS)
    got = {(r["replicate"], r["climate_region"]): r for r in replicates.refit(drawn, df, "y", 40, 0.0, 1.0).collect()}
    dropped = 0
    for k in (1, 2):
        copied = bootstrap.materialised(drawn.where(F.col("replicate") == k), df.drop("climate_region").withColumn("climate_region", F.lit("x")))
        counts = copied.groupBy("climate_region", "bin").agg(F.count_if(F.col("later") == 0).alias("e"), F.count_if(F.col("later") == 1).alias("l")).where("e >= 40 and l >= 40")
        own = copied.join(counts.select("climate_region", "bin"), ["climate_region", "bin"])
        dropped += copied.count() - own.count()
        with_b, ts, ss = regression.with_splines(own)
        design = regression.Design("later", ts, ss)
        with_r, xs = design.columns(with_b)
        means = regression.site_means(with_b, regression.fit(with_r, xs, "y"), design, 0.0, 1.0).groupBy("climate_region").agg(*[F.avg(c).alias(c) for c in "ABCD"], F.count("*").alias("n")).collect()
        for m in means:
            r = got[k, m["climate_region"]]
            assert r["failure"] is None and r["n_sites"] == m["n"] and all(r[c] == pytest.approx(m[c], abs=1e-7) for c in "ABCD")
    assert dropped and len(got) == 4
    none = replicates.refit(drawn, df, "y", 10_000, 0.0, 1.0).collect()
    assert {r["failure"] for r in none} == {"support: no bin"}


def test_splines_are_smooth_and_reach_their_knots():
    knots = np.array([0.0, 1.0, 2.5, 4.0])
    assert np.allclose(splines.evaluate(knots, knots, False), np.eye(4))
    x = np.linspace(0, 4, 9)
    assert np.allclose(splines.evaluate(x, knots, False) @ (3 * knots + 1), 3 * x + 1)  # a line stays a line
    cyclic = splines.evaluate(np.array([0.0, 4.0]), knots, True)
    assert np.allclose(cyclic[0], cyclic[1])
    for k, around in ((knots, False), (knots, True)):
        p = splines.pieces(k, around)
        at = np.clip(np.searchsorted(k, x, "right") - 1, 0, len(k) - 2)
        assert np.allclose(sum(p[at, i] * ((x - k[at]) ** i)[:, None] for i in range(4)), splines.evaluate(x, k, around))
    basis = splines.centred(knots, False, x, np.ones(9))
    assert basis(x).shape == (9, 3) and np.allclose(basis(x).sum(0), 0)
    with pytest.raises(ValueError):
        splines.evaluate(np.array([4.1]), knots, False)


def test_components(spark):
    sites = spark.createDataFrame([("R", "s", 1.0, 2.0, 4.0, 7.0)], "climate_region string, site_id string, A double, B double, C double, D double")
    got = regression.decomposition(sites).where("scope = 'R'").first()
    assert (got["temperature_component"], got["response_component"], got["total_change"]) == (2.0, 4.0, 6.0)


@pytest.mark.parametrize(("low", "high", "expected"), [(-1.0, 2.0, "includes zero"), (0.1, 2.0, "above zero"), (-2.0, -1.0, "below zero"), (0.0, 1.0, "includes zero")])
def test_relation_to_zero(spark, low, high, expected):
    assert one(spark, a=low, b=high).select(C.relation_to_zero(F.col("a"), F.col("b"))).first()[0] == expected


def test_draws_follow_the_generator(spark):
    sites = spark.createDataFrame([("B", "s3"), ("A", "s1"), ("A", "s2")], "climate_region string, site_id string")
    got = bootstrap.draws(spark, sites, 3, 99).where("replicate = 2").orderBy("climate_region", "draw_index").collect()
    rng = np.random.default_rng(bootstrap.replicate_seed(99, 2))
    expected = rng.choice(["s1", "s2"], size=2).tolist() + rng.choice(["s3"], size=1).tolist()
    assert [r["source_site"] for r in got] == expected
    assert got[0]["bootstrap_site"] == f"A::draw-0000::{expected[0]}"


def test_weights_equal_copies(spark):
    sites = spark.createDataFrame([("R", s) for s in "abc"], "climate_region string, site_id string")
    rows = spark.createDataFrame([(s, "R", p, float(60 + 15 * ((i + ord(s)) % 2))) for s in "abc" for p in ("early", "later") for i in range(3 + ord(s) % 3)], "site_id string, climate_region string, period string, ozone_mda8_ppb double")
    drawn = bootstrap.draws(spark, sites, 5, 1)
    weighted = bootstrap.burden(drawn, descriptive.site_periods(rows, 70.0)).where("scope = 'R'")
    copied = bootstrap.materialised(drawn, rows)
    by_site = copied.groupBy("replicate", "site_id", "period").agg(F.avg((F.col("ozone_mda8_ppb") > 70).cast("int")).alias("p"))
    expected = {(r["replicate"], r["period"]): r["m"] for r in by_site.groupBy("replicate", "period").agg(F.avg("p").alias("m")).collect()}
    for r in weighted.collect():
        assert r["equal_site_share"] == pytest.approx(expected[r["replicate"], r["period"]])


def test_unfinished_replicates(spark):
    attempts = spark.createDataFrame([(1, True), (2, False)], "replicate long, success boolean")
    left = bootstrap.unfinished(spark.range(1, 4).withColumnRenamed("id", "replicate"), attempts)
    assert {r["replicate"] for r in left.collect()} == {2, 3}


def test_sensitivity_directions(spark):
    schema = "scope string, temperature_component double, response_component double"
    a = spark.createDataFrame([("x", 1.0, 1.0), ("y", 1.0, -1.0), ("z", 1.0, 0.0)], schema)
    b = spark.createDataFrame([("x", -0.2, 1.0), ("y", 1.2, 1.0), ("z", 1.0, 1.0)], schema)
    got = {r["scope"]: (r["direction"], r["is_major"], r["primary_relation"]) for r in compare.sensitivity(a, b).collect()}
    assert got == {"x": ("reversed", True, "reinforce"), "y": ("strengthened", False, "oppose"), "z": ("unchanged", False, "effectively zero")}


def test_a_fit_refuses_rows_it_must_not_have(spark):
    good = [(s, "R", p, float(t), 1 + t, 5.0) for s in "ab" for p in ("early", "later") for t in range(3)]
    schema = "site_id string, climate_region string, period string, tmax_c double, day_of_year int, y double"
    audits.required(audits.model_frame_checks(spark.createDataFrame(good, schema), "y"))
    for change, said in (([("a", "Q", "early", 1.0, 1, 5.0)], "several regions"), ([("c", "R", "early", 1.0, 1, 5.0)], "without a period"), ([("a", "R", "early", float("nan"), 1, 5.0)], "not finite"), ([("a", "R", "early", 1.0, 1, None)], "missing"), ([("a", "R", "x", 1.0, 1, 5.0)], "other periods")):
        with pytest.raises(ValueError, match=said):
            audits.required(audits.model_frame_checks(spark.createDataFrame(good + change, schema), "y"))
    with pytest.raises(ValueError, match="no rows"):
        audits.required(audits.model_frame_checks(spark.createDataFrame([], schema), "y"))


def test_file_stamps(spark):
    names = spark.createDataFrame([("a",), ("b",)], "file string")
    listing = spark.createDataFrame([("a", date(2026, 1, 10)), ("b", date(2025, 12, 30)), ("c", None)], "file string, created date")
    manifest = spark.createDataFrame([("a", "r1", "m1"), ("b", "r2", None)], "file string, retrieved string, modified string")
    got = {r["file"]: (r["lag_days"], r["retrieved"], r["modified"]) for r in audits.file_stamps(names, listing, manifest, 2025).collect()}
    assert got == {"a": (10, "r1", "m1"), "b": (-1, "r2", None)}
    for bad_listing, bad_manifest, said in ((listing.where("file <> 'a'"), manifest, "listing: a"), (listing, manifest.unionByName(manifest.limit(1)), "manifest: a")):
        with pytest.raises(Exception, match=said):
            audits.file_stamps(names, bad_listing, bad_manifest, 2025).collect()


def test_no_extrapolation(spark):
    rows = spark.createDataFrame([("s", float(t), 1 + 40 * t) for t in range(9)], "site_id string, tmax_c double, day_of_year int")
    wide = rows.unionByName(rows.limit(1).withColumn("tmax_c", F.lit(99.0)))
    with pytest.raises(Exception, match="outside the fitted range"):
        regression.with_splines(wide, rows)[0].collect()
    clipped, ts, ss = regression.with_splines(wide, rows, extrapolate=True)
    values = {r["tmax_c"]: [r[t] for t in ts] for r in clipped.collect()}
    assert values[99.0] == pytest.approx(values[8.0]) and len(ss) == 6


def test_bases_as_columns_equal_the_functions(spark):
    rng = np.random.default_rng(3)
    t, d = np.round(rng.uniform(-5, 40, 300), 1), rng.integers(1, 366, 300)
    rows = spark.createDataFrame(pd.DataFrame({"tmax_c": t, "day_of_year": d.astype("int32")}))
    got, ts, ss = regression.with_splines(rows)
    got = got.toPandas()
    basis = splines.centred(np.quantile(t, [0, 0.25, 0.5, 0.75, 1]), False, t, np.ones(300))
    assert np.allclose(got[list(ts)], basis(got["tmax_c"].to_numpy()), atol=1e-9)
    days, n = np.unique(d, return_counts=True)
    cycle = splines.centred(np.concatenate(([1.0], np.quantile(days, np.linspace(0, 1, 8)[1:-1]), [365.0])), True, days, n)
    assert np.allclose(got[list(ss)], cycle(got["day_of_year"].to_numpy()), atol=1e-9)


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", None], 500), "v": np.round(rng.normal(size=500), 1)})
    frame.loc[::7, "v"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("v", F.nanvl("v", F.lit(None)))
    got = {r["g"]: r["q"] for r in tables.quantiles(rows, "v", (0.0, 0.1, 0.5, 1.0), "g").collect()}
    for g in ("a", "b", None):
        own = frame.v[frame.g.isna() if g is None else frame.g == g].dropna()
        assert got[g] == pytest.approx(list(own.quantile([0, 0.1, 0.5, 1])))
    assert tables.quantiles(rows.limit(0), "v", (0.5,)).count() == 0


def test_vectors_add_up(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.choice(["x", "y", None], 400), "b": rng.integers(0, 30, 400), "v": list(rng.normal(size=(400, 3)))})
    rows = spark.createDataFrame(frame[["a", "b"]].assign(v=[v.tolist() for v in frame.v])).repartition(7)
    got = {(r["a"], r["b"]): r["v"] for r in vectors.met(vectors.partly_summed(rows, ["a", "b"]), ["a", "b"]).collect()}
    expected = {(None if a != a or a is None else a, b): np.sum(np.stack(list(g)), 0) for (a, b), g in frame.groupby(["a", "b"], dropna=False).v}
    assert set(got) == set(expected) and all(np.allclose(got[k], expected[k]) for k in got)


def test_quantile_error_and_contribution(spark):
    v = np.random.default_rng(5).normal(size=200)
    got = audits.quantile_error(spark.createDataFrame(pd.DataFrame({"k": "a", "value": v})), (0.025, 0.5), "k").first()
    for i, p in enumerate((0.025, 0.5)):
        far = min(0.1, 1.96 * np.sqrt(200 * p * (1 - p)) / 200)
        low, high = np.quantile(v, [max(0, p - far), min(1, p + far)])
        assert got[f"error_{i}"] == pytest.approx((high - low) / 2, abs=1e-6)
    rows = spark.createDataFrame([(1.0, 4.0, 0.5, 2.0, 3.0, 5.0), (-1.0, 4.0, -2.0, -0.5, 3.0, 5.0), (1.0, 4.0, 0.5, 2.0, -1.0, 5.0), (1.0, 4.0, -0.5, 2.0, 3.0, 5.0)], "c double, t double, cl double, ch double, tl double, th double")
    args = (F.col("c"), F.col("t"), (F.col("cl"), F.col("ch")), (F.col("tl"), F.col("th")))
    share, reason = audits.contribution(*args, least_total=1.0)
    assert [tuple(r) for r in rows.select(share, reason).collect()] == [(25.0, None), (None, "components oppose"), (None, "total interval includes zero"), (None, "component interval includes zero")]
    assert rows.select(audits.contribution(*args)[1]).first()[0] == "no least total is set"


def test_separation_by_a_column(spark):
    rows = [("A", "a", x, int(x > 2)) for x in range(5)] + [("A", "b", x, int(x > 0)) for x in range(3)] + [("A", "c", 1, 0)]  # complete, with a site that never varies
    rows += [("B", "d", x, y) for x, y in ((0, 0), (1, 0), (1, 1), (2, 1))]  # quasi
    rows += [("C", "e", 0, 0), ("C", "e", 1, 1), ("C", "f", 0, 1), ("C", "f", 1, 0)]  # two directions
    rows += [("D", "g", 0, 1)]
    got = {r["climate_region"]: r["separation"] for r in audits.separation(spark.createDataFrame(rows, "climate_region string, site_id string, x int, y int"), "x", "y").collect()}
    assert got == {"A": "complete", "B": "quasi", "C": "none", "D": "no site varies"}


def test_tables_need_a_shared_folder_on_a_cluster():
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "yarn"})

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="share"):
        tables.kept(Frame())


def test_a_fit_refuses_another_population(spark, tmp_path):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"site_id": [f"s{i % 4}" for i in range(80)], "climate_region": "R", "x": rng.normal(size=80), "y": rng.normal(size=80)})
    spark.createDataFrame(frame).write.parquet(f"{tmp_path}/p")
    rows = spark.read.parquet(f"{tmp_path}/p")
    stored = rows.agg(*population.fingerprint("site_id", "x", "y")).first().asDict()
    assert stored["n_rows"] == 80
    found = regression.fit_verified(rows.repartition(7), ["x"], "y", ["site_id", "x", "y"], stored)
    assert found.first()["beta"] == pytest.approx(regression.fit(rows, ["x"], "y").first()["beta"])
    for changed in (rows.withColumn("y", F.when((F.col("site_id") == "s1") & (F.col("x") > 1), 0.0).otherwise(F.col("y"))), rows.limit(79), rows.unionByName(rows.limit(1))):
        with pytest.raises(ValueError, match="not the stored one"):
            regression.fit_verified(changed, ["x"], "y", ["site_id", "x", "y"], stored)
    seen, _ = population.watched(rows, "x")
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
