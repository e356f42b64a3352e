"""Queries on eligibility, support, population variants and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.config import SAMPLE
from paneloom.functions import columns as C
from paneloom.operators import population as P
from paneloom.operators.tables import kept, quantiles
from paneloom.sources import adapters as A


def _years(spark, d):
    return P.site_years(A.panel(spark, d), SAMPLE)


def _balance(spark, d, assign=None):
    return P.site_balance(_years(spark, d), SAMPLE, assign)


def _base(spark, d, assign=None):
    """Rows of balanced sites; the panel is written once, as its years and its rows both are read."""
    panel = kept(A.panel(spark, d), "panel")
    sites = P.balanced(P.site_balance(P.site_years(panel, SAMPLE), SAMPLE, assign), SAMPLE.min_years)
    return P.base_rows(panel, sites, assign)


def _fit_rows(spark, d, assign=None):
    """What fits read: base rows in bins with common support, without leap days, written once."""
    return kept(P.drop_leap_days(P.supported_rows(_base(spark, d, assign), SAMPLE)), "fit-rows")


def site_year_coverage(spark, d):
    return _years(spark, d).withColumn("coverage", F.round("coverage", 9))


def balanced_sites(spark, d):
    return P.balanced(_balance(spark, d), SAMPLE.min_years)


def network_sites(spark, d):
    return P.balanced(_balance(spark, d), 1)


def support_bins(spark, d):
    return P.support_counts(_base(spark, d), SAMPLE)


def supported_rows(spark, d):
    return P.supported_rows(_base(spark, d), SAMPLE).select("site_id", "date_local", "bin", "period", "tmax_c", "ozone_mda8_ppb")


def support_flags(spark, d):
    return P.support_flags(_base(spark, d), SAMPLE).select("site_id", "date_local", "bin", "supported")


def region_retention(spark, d):
    return P.retention(_base(spark, d), SAMPLE)


def region_retention_after_leap(spark, d):
    return P.retention(_base(spark, d), SAMPLE, after_leap=True)


def region_retention_supported_sites(spark, d):
    return P.retention(_base(spark, d), SAMPLE, supported_sites=True)


def population_flow(spark, d):
    panel = kept(A.panel(spark, d), "panel")
    years = P.site_years(panel, SAMPLE)
    sites = P.balanced(P.site_balance(years, SAMPLE), SAMPLE.min_years).select("site_id", F.lit(True).alias("is_balanced"))
    years = years.select("site_id", "calendar_year", "qualifies")
    rows = panel.join(years, ["site_id", "calendar_year"]).join(sites, "site_id", "left")
    stages = [
        ("all rows", F.lit(True)),
        ("eligible site-years", F.col("qualifies")),
        ("balanced sites", F.col("is_balanced")),
        ("without transition", F.col("period") != "transition"),
        ("without leap days", F.date_format("date_local", "MM-dd") != "02-29"),
    ]
    return P.flow(rows, stages)


def panel_integrity(spark, d):
    return P.integrity(A.panel(spark, d), SAMPLE)


def _status():
    return F.when(F.col("status_code") == "A", "identified").when(F.col("status_code") == "N", "retained")


def _quality(spark, d):
    return _base(spark, d).withColumns({"event_status": _status(), "certified": F.col("cert_code") == "F"})


def value_counts_nulls(spark, d):
    return P.value_counts(A.panel(spark, d).withColumn("event_status", _status()), "event_status")


def event_cert_crosstab(spark, d):
    rows = A.panel(spark, d).withColumn("event_status", F.coalesce(_status(), F.lit("missing")))
    return rows.groupingSets([["event_status"], ["cert_code"], ["event_status", "cert_code"], []], "event_status", "cert_code").agg(
        F.grouping_id("event_status", "cert_code").cast("long").alias("level"), F.count("*").alias("n_rows")
    )


def outcome_support(spark, d):
    return P.outcome_support(_base(spark, d), SAMPLE)


def transition_assigned_early(spark, d):
    return P.support_counts(_base(spark, d, "early"), SAMPLE)


def transition_assigned_later(spark, d):
    return P.support_counts(_base(spark, d, "later"), SAMPLE)


def _summary(rows):
    return rows.groupBy("climate_region", "period").agg(F.count("*").alias("n_rows"), F.count_distinct("site_id").alias("n_sites"), F.round(F.avg("ozone_mda8_ppb"), 6).alias("mean_outcome"))


def event_clean(spark, d):
    rows = _quality(spark, d).where(F.coalesce(F.col("event_status") == "retained", F.lit(False)))
    return _summary(P.common_sites(rows))


def quality_site_years(spark, d):
    return _summary(P.common_sites(P.whole_quality_years(_quality(spark, d), SAMPLE, F.col("certified") | (F.day("date_local") > 3))))


def event_and_quality(spark, d):
    rows = P.whole_quality_years(_quality(spark, d), SAMPLE, F.col("certified") | (F.day("date_local") > 3))
    return _summary(P.common_sites(rows.where(F.coalesce(F.col("event_status") == "retained", F.lit(False)))))


def candidate_filters(spark, d):
    """One row for each filter: row, site-year and site kinds."""
    rows = kept(_quality(spark, d).select("site_id", "calendar_year", "event_status", (F.col("ozone_mda8_ppb") > 100).alias("high")), "filtered-rows")
    marked = rows.where("high")
    kinds = {
        "rows": rows.where("not high"),
        "site-years": P.without_affected(rows, marked, ["site_id", "calendar_year"]),
        "sites": P.without_affected(rows, marked, ["site_id"]),
        "events": rows.where(F.coalesce(F.col("event_status") != "identified", F.lit(True))),
    }
    out = None
    for name, some in kinds.items():
        one = some.agg(F.lit(name).alias("candidate"), F.count("*").alias("n_rows"), F.count_distinct("site_id").alias("n_sites"))
        out = one if out is None else out.unionByName(one)
    return out


def population_set_differences(spark, d):
    return P.set_difference(balanced_sites(spark, d), P.balanced(_balance(spark, d, "later"), SAMPLE.min_years + 1), "site_id", ("primary only", "variant only"))


def knot_quantiles(spark, d):
    rows = quantiles(_base(spark, d), "tmax_c", (0.25, 0.5, 0.75, 1 / 3, 2 / 3, 0.0, 1.0), "climate_region")
    return rows.select("climate_region", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(5)], F.col("q")[5].alias("lo"), F.col("q")[6].alias("hi"))


def site_temperature_histogram(spark, d):
    return _base(spark, d).groupBy("site_id", "period", "tmax_c").agg(F.count("*").alias("n_rows"))


def panel_row_order(spark, d):
    return P.panel_rows(A.panel(spark, d)).select("panel_row", "site_id", "date_local")


def site_identity(spark, d):
    """Order-free identity of the balanced sites: their sorted names' SHA-256, by region."""
    return balanced_sites(spark, d).groupBy("climate_region").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("site_id")), ","), 256).alias("sha256"), F.count("*").alias("n_sites"))


def hash_proportions(spark, d):
    sites = A.suppliers(spark, d)
    return sites.select("site_id", F.round(C.hash_proportion(F.col("site_id")), 6).alias("proportion"))


BASE_SQL = f"""
{A.PANEL_SQL},
years AS (
  SELECT site_id, climate_region, calendar_year, count(*) AS n_days, count(*) / dayofyear(make_date(calendar_year, 12, 31)) AS coverage,
         count(*) / dayofyear(make_date(calendar_year, 12, 31)) >= 0.2::DOUBLE AS qualifies
  FROM panel GROUP BY 1, 2, 3),
balance AS (SELECT site_id, climate_region, count(*) FILTER (qualifies AND calendar_year BETWEEN 1995 AND 1997) AS early_years, count(*) FILTER (qualifies AND calendar_year BETWEEN 1999 AND 2001) AS later_years FROM years GROUP BY 1, 2),
balance_e AS (SELECT site_id, climate_region, count(*) FILTER (qualifies AND calendar_year BETWEEN 1995 AND 1998) AS early_years, count(*) FILTER (qualifies AND calendar_year BETWEEN 1999 AND 2001) AS later_years FROM years GROUP BY 1, 2),
balance_l AS (SELECT site_id, climate_region, count(*) FILTER (qualifies AND calendar_year BETWEEN 1995 AND 1997) AS early_years, count(*) FILTER (qualifies AND calendar_year BETWEEN 1998 AND 2001) AS later_years FROM years GROUP BY 1, 2),
balanced AS (SELECT * FROM balance WHERE early_years >= 2 AND later_years >= 2),
base AS (SELECT * FROM panel WHERE period IN ('early', 'later') AND site_id IN (SELECT site_id FROM balanced)),
base_e AS (SELECT * REPLACE (CASE WHEN period = 'transition' THEN 'early' ELSE period END AS period) FROM panel WHERE period IS NOT NULL AND site_id IN (SELECT site_id FROM balance_e WHERE early_years >= 2 AND later_years >= 2)),
base_l AS (SELECT * REPLACE (CASE WHEN period = 'transition' THEN 'later' ELSE period END AS period) FROM panel WHERE period IS NOT NULL AND site_id IN (SELECT site_id FROM balance_l WHERE early_years >= 2 AND later_years >= 2)),
binned AS (SELECT *, floor(tmax_c / 2.0) * 2.0 AS bin FROM base),
bins AS (SELECT climate_region, bin, count(*) FILTER (period = 'early') AS n_early, count(*) FILTER (period = 'later') AS n_later,
         count(*) FILTER (period = 'early') >= 75 AND count(*) FILTER (period = 'later') >= 75 AS supported FROM binned GROUP BY 1, 2),
flags AS (SELECT b.*, supported, month(date_local) = 2 AND day(date_local) = 29 AS leap FROM binned b JOIN bins USING (climate_region, bin)),
fitrows AS (SELECT * FROM flags WHERE supported AND NOT leap),
binned_l AS (SELECT *, floor(tmax_c / 2.0) * 2.0 AS bin FROM base_l),
fitrows_l AS (
  SELECT * FROM binned_l JOIN (SELECT climate_region, bin FROM binned_l GROUP BY 1, 2 HAVING count(*) FILTER (period = 'early') >= 75 AND count(*) FILTER (period = 'later') >= 75) USING (climate_region, bin)
  WHERE NOT (month(date_local) = 2 AND day(date_local) = 29)),
quality AS (SELECT *, CASE status_code WHEN 'A' THEN 'identified' WHEN 'N' THEN 'retained' END AS event_status, cert_code = 'F' OR day(date_local) > 3 AS passes FROM base),
quality_years AS (SELECT * FROM quality q WHERE NOT EXISTS (SELECT 1 FROM quality b WHERE b.calendar_year = 2001 AND NOT b.passes AND b.site_id = q.site_id AND b.calendar_year = q.calendar_year))"""


def _retention_sql(kept: str, site: str) -> str:
    return f"""WITH {BASE_SQL}, r AS (
      SELECT climate_region, count(*) FILTER (period = 'early') AS early_rows, count(*) FILTER (period = 'later') AS later_rows,
             count(*) FILTER (period = 'early' AND {kept}) AS early_kept, count(*) FILTER (period = 'later' AND {kept}) AS later_kept,
             count(DISTINCT {site}) AS n_sites, count(DISTINCT CASE WHEN supported THEN bin END) AS n_bins FROM flags GROUP BY 1)
    SELECT *, round(early_kept / early_rows, 9) AS early_share, round(later_kept / later_rows, 9) AS later_share,
      CASE WHEN n_bins = 0 THEN 'no supported bin' WHEN n_sites < 8 THEN 'too few sites' WHEN early_kept < 0.8 * early_rows OR later_kept < 0.8 * later_rows THEN 'low retention' ELSE 'estimable' END AS verdict FROM r"""


def _summary_sql(rows: str) -> str:
    return f"""WITH {BASE_SQL}, r AS ({rows}), c AS (SELECT * FROM r WHERE site_id IN (SELECT site_id FROM r GROUP BY 1 HAVING count(DISTINCT period) = 2))
    SELECT climate_region, period, count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, round(avg(ozone_mda8_ppb), 6) AS mean_outcome FROM c GROUP BY 1, 2"""


def _bins_sql(rows: str) -> str:
    return f"""WITH {BASE_SQL} SELECT climate_region, floor(tmax_c / 2.0) * 2.0 AS bin, count(*) FILTER (period = 'early') AS n_early, count(*) FILTER (period = 'later') AS n_later,
      count(*) FILTER (period = 'early') >= 75 AND count(*) FILTER (period = 'later') >= 75 AS supported FROM {rows} GROUP BY 1, 2"""


QUERIES = {
    f.__name__: f
    for f in (
        site_year_coverage, balanced_sites, network_sites, support_bins, supported_rows, support_flags, region_retention, region_retention_after_leap, region_retention_supported_sites,
        population_flow, panel_integrity, value_counts_nulls, event_cert_crosstab, outcome_support, transition_assigned_early, transition_assigned_later, event_clean, quality_site_years,
        event_and_quality, candidate_filters, population_set_differences, knot_quantiles, site_temperature_histogram, panel_row_order, site_identity, hash_proportions,
    )
}

ORACLES = {
    "site_year_coverage": f"WITH {BASE_SQL} SELECT site_id, climate_region, calendar_year, n_days, round(coverage, 9) AS coverage, qualifies FROM years",
    "balanced_sites": f"WITH {BASE_SQL} SELECT * FROM balanced",
    "network_sites": f"WITH {BASE_SQL} SELECT * FROM balance WHERE early_years >= 1 AND later_years >= 1",
    "support_bins": f"WITH {BASE_SQL} SELECT * FROM bins",
    "supported_rows": f"WITH {BASE_SQL} SELECT site_id, date_local, bin, period, tmax_c, ozone_mda8_ppb FROM flags WHERE supported",
    "support_flags": f"WITH {BASE_SQL} SELECT site_id, date_local, bin, supported FROM flags",
    "region_retention": _retention_sql("supported", "site_id"),
    "region_retention_after_leap": _retention_sql("supported AND NOT leap", "site_id"),
    "region_retention_supported_sites": _retention_sql("supported", "CASE WHEN supported THEN site_id END"),
    "population_flow": f"""WITH {BASE_SQL}, r AS (SELECT p.*, qualifies, b.site_id IS NOT NULL AS is_balanced FROM panel p JOIN years USING (site_id, calendar_year) LEFT JOIN balanced b ON p.site_id = b.site_id)
        SELECT 0 AS step, 'all rows' AS stage, count(*) AS n_rows, count(DISTINCT site_id) AS n_sites FROM r
        UNION ALL SELECT 1, 'eligible site-years', count(*), count(DISTINCT site_id) FROM r WHERE qualifies
        UNION ALL SELECT 2, 'balanced sites', count(*), count(DISTINCT site_id) FROM r WHERE qualifies AND is_balanced
        UNION ALL SELECT 3, 'without transition', count(*), count(DISTINCT site_id) FROM r WHERE qualifies AND is_balanced AND period <> 'transition'
        UNION ALL SELECT 4, 'without leap days', count(*), count(DISTINCT site_id) FROM r WHERE qualifies AND is_balanced AND period <> 'transition' AND NOT (month(date_local) = 2 AND day(date_local) = 29)""",
    "panel_integrity": f"""WITH {A.PANEL_SQL}, k AS (SELECT site_id, date_local, count(*) AS n, count(DISTINCT climate_region) AS r FROM panel GROUP BY 1, 2)
        SELECT count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, count(*) FILTER (period IS NULL) AS rows_outside_one_period, count(*) FILTER (tmax_c IS NULL) AS null_tmax,
          count(*) FILTER (ozone_mda8_ppb IS NULL) AS null_outcome, 0::BIGINT AS flag_disagreements, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM k) AS extra_rows,
          (SELECT count(*) FROM k WHERE n > 1) AS repeated_keys, (SELECT count(*) FROM k WHERE r > 1) AS keys_in_two_regions FROM panel""",
    "value_counts_nulls": f"WITH {A.PANEL_SQL} SELECT coalesce(CASE status_code WHEN 'A' THEN 'identified' WHEN 'N' THEN 'retained' END, 'missing') AS value, count(*) AS n_rows FROM panel GROUP BY 1",
    "event_cert_crosstab": f"""WITH {A.PANEL_SQL}, e AS (SELECT coalesce(CASE status_code WHEN 'A' THEN 'identified' WHEN 'N' THEN 'retained' END, 'missing') AS event_status, cert_code FROM panel)
        SELECT event_status, cert_code, CAST(grouping(event_status, cert_code) AS BIGINT) AS level, count(*) AS n_rows FROM e GROUP BY GROUPING SETS ((event_status), (cert_code), (event_status, cert_code), ())""",
    "outcome_support": f"""WITH {BASE_SQL}, s AS (SELECT climate_region, site_id, min(ozone_mda8_ppb > 70) AS lo, max(ozone_mda8_ppb > 70) AS hi, count(*) FILTER (ozone_mda8_ppb > 70) AS ones, count(*) AS n FROM base GROUP BY 1, 2)
        SELECT climate_region, count(*) FILTER (NOT hi) AS all_zero_sites, count(*) FILTER (lo) AS all_one_sites, count(*) FILTER (hi AND NOT lo) AS varying_sites,
          CAST(sum(ones) AS BIGINT) AS n_elevated, CAST(sum(n) AS BIGINT) AS n_rows FROM s GROUP BY 1""",
    "transition_assigned_early": _bins_sql("base_e"),
    "transition_assigned_later": _bins_sql("base_l"),
    "event_clean": _summary_sql("SELECT * FROM quality WHERE event_status = 'retained'"),
    "quality_site_years": _summary_sql("SELECT * FROM quality_years"),
    "event_and_quality": _summary_sql("SELECT * FROM quality_years WHERE event_status = 'retained'"),
    "candidate_filters": f"""WITH {BASE_SQL}, high AS (SELECT DISTINCT site_id, calendar_year FROM base WHERE ozone_mda8_ppb > 100)
        SELECT 'rows' AS candidate, count(*) AS n_rows, count(DISTINCT site_id) AS n_sites FROM base WHERE NOT ozone_mda8_ppb > 100
        UNION ALL SELECT 'site-years', count(*), count(DISTINCT site_id) FROM base WHERE (site_id, calendar_year) NOT IN (SELECT site_id, calendar_year FROM high)
        UNION ALL SELECT 'sites', count(*), count(DISTINCT site_id) FROM base WHERE site_id NOT IN (SELECT site_id FROM high)
        UNION ALL SELECT 'events', count(*), count(DISTINCT site_id) FROM quality WHERE event_status IS NULL OR event_status <> 'identified'""",
    "population_set_differences": f"""WITH {BASE_SQL}, v AS (SELECT site_id FROM balance_l WHERE early_years >= 3 AND later_years >= 3)
        SELECT site_id, 'primary only' AS side FROM balanced WHERE site_id NOT IN (SELECT site_id FROM v) UNION ALL SELECT site_id, 'variant only' FROM v WHERE site_id NOT IN (SELECT site_id FROM balanced)""",
    "knot_quantiles": f"""WITH {BASE_SQL} SELECT climate_region, round(quantile_cont(tmax_c, 0.25), 6) AS q0, round(quantile_cont(tmax_c, 0.5), 6) AS q1, round(quantile_cont(tmax_c, 0.75), 6) AS q2,
        round(quantile_cont(tmax_c, 0.3333333333333333), 6) AS q3, round(quantile_cont(tmax_c, 0.6666666666666666), 6) AS q4, min(tmax_c) AS lo, max(tmax_c) AS hi FROM base GROUP BY 1""",
    "site_temperature_histogram": f"WITH {BASE_SQL} SELECT site_id, period, tmax_c, count(*) AS n_rows FROM base GROUP BY 1, 2, 3",
    "panel_row_order": f"WITH {A.PANEL_SQL} SELECT row_number() OVER (ORDER BY site_id, date_local) - 1 AS panel_row, site_id, date_local FROM panel",
    "site_identity": f"WITH {BASE_SQL} SELECT climate_region, sha256(string_agg(site_id, ',' ORDER BY site_id)) AS sha256, count(*) AS n_sites FROM balanced GROUP BY 1",
    "hash_proportions": f"WITH {A.PANEL_SQL} SELECT site_id, round(CAST(CAST('0x' || sha256(site_id)[1:16] AS UBIGINT) % 1000001 AS DOUBLE) / 1000000.0, 6) AS proportion FROM suppliers",
}
