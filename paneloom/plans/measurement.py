"""Queries on hourly rows: ledgers, monitors, daily maxima."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.config import SAMPLE
from paneloom.functions import columns as C
from paneloom.operators import measurement as M
from paneloom.sources import adapters as A

#: Hours from the first day on, so that days are dense enough for 13 windows.
KEYS = ["site", "date_local", "local_hour"]


def _rules():
    code = F.expr("try_cast(code as int)")
    return [
        ("missing field", F.col("kind").isNull() | F.col("value").isNull()),
        ("not the target", F.col("kind") == "error"),
        ("units", F.col("value") > 100),
        ("qualifier", code % 2 == 1),
        ("out of scope", F.col("local_hour") >= 22),
        ("site", F.col("site") < 0),
    ]


RULES_SQL = """
CASE WHEN kind IS NULL OR value IS NULL THEN 'missing field' WHEN kind = 'error' THEN 'not the target' WHEN value > 100 THEN 'units'
     WHEN TRY_CAST(code AS INTEGER) % 2 = 1 THEN 'qualifier' WHEN local_hour >= 22 THEN 'out of scope' WHEN site < 0 THEN 'site' END"""


def classify_ledger(spark, d):
    return M.ledger(M.classified(A.raw_rows(spark, d), _rules()), "site")


def clean_rows(spark, d):
    rows = M.classified(A.raw_rows(spark, d), _rules()).where("reason is null")
    name = F.concat_ws("-", F.lit("01"), F.lpad((F.col("site") % 1000).cast("string"), 3, "0"), F.lit("0001"))
    return rows.select("event_id", name.alias("site_id"), "date_local", "local_hour", C.truncated_ppb(F.col("value") / 1000.0).alias("ppb"))


def poc_resolution(spark, d):
    return M.resolve_monitors(A.hourly(spark, d), KEYS)


def poc_ledger_by_site(spark, d):
    found = M.resolve_monitors(A.hourly(spark, d), KEYS)
    return found.groupBy("site").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("missing", "keep", "ambiguous")], F.sum("duplicate_rows").alias("duplicate_rows"))


def primary_first_substitution(spark, d):
    return M.primary_first(A.hourly(spark, d), KEYS, "view").select(*KEYS, F.round("ppb", 6).alias("ppb"), "from_primary")


def duplicate_multiplicity(spark, d):
    return M.multiplicity(A.hourly(spark, d), [*KEYS, "poc"])


def _windows(spark, d):
    hours = M.primary_first(A.hourly(spark, d), KEYS, "view").withColumn("ppb", F.floor("ppb").cast("double"))
    return M.daily_windows(hours, "site", SAMPLE)


def daily_mda8(spark, d):
    return _windows(spark, d)


def target_day_hours(spark, d):
    """Which days of a monitor have exactly the hours that windows need."""
    found = M.hour_checks(A.hourly(spark, d), ["site", "poc"], SAMPLE)
    return found.select("site", "poc", "date_local", "n_rows", F.size("missing").cast("long").alias("n_missing"), F.size("repeated").cast("long").alias("n_repeated"), "verdict")


def mda8_failed_days(spark, d):
    found = M.day_spine(_windows(spark, d), "site")
    return found.where("mda8 is null").select("site", "date_local", F.coalesce("n_hours", F.lit(0)).alias("n_hours"), F.coalesce("valid_windows", F.lit(0)).alias("valid_windows"))


def daily_pocs_list(spark, d):
    hours = M.primary_first(A.hourly(spark, d), KEYS, "view")
    return hours.groupBy("site", "date_local").agg(C.join_sorted(F.flatten(F.collect_list("pocs"))).alias("pocs"))


def daily_reconciliation(spark, d):
    days = _windows(spark, d).select("site", "date_local", "mda8")
    shift = F.when(F.day("date_local") % 3 == 0, 0.0).when(F.day("date_local") % 3 == 1, 0.4).otherwise(2.0)
    official = days.where(F.day("date_local") % 7 != 0).withColumn("value", F.col("mda8") + shift)
    official = official.unionByName(official.where(F.day("date_local") % 5 == 0))
    return M.reconciled(days, official, ["site", "date_local"]).select("site", "date_local", "mda8", F.round("official", 6).alias("official"), "agreement")


def first_hour_of_year(spark, d):
    rows = M.first_by_year(A.hourly(spark, d), "site", "ppb")
    return rows.groupBy("site").agg(F.max("year_first").alias("year_first"), F.count("*").alias("n_rows"))


WINDOWS_SQL = f"""
{A.HOURLY_SQL},
single AS (SELECT site, date_local, local_hour, poc, min(ppb) AS ppb FROM hourly GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
hours AS (
  SELECT site, date_local, local_hour, coalesce(max(ppb) FILTER (poc = 'view'), avg(ppb) FILTER (poc <> 'view')) AS ppb,
         max(ppb) FILTER (poc = 'view') IS NOT NULL AS from_primary, list(poc) AS pocs
  FROM single GROUP BY 1, 2, 3),
rel AS (
  SELECT site, CAST(date_local - CASE WHEN local_hour < 7 THEN 1 ELSE 0 END AS DATE) AS day, (local_hour + 17) % 24 + 7 AS rel, floor(ppb) AS ppb FROM hours),
starts AS (SELECT unnest(range(7, 24)) AS s),
windows AS (
  SELECT site, day, s, floor(avg(ppb)) AS v FROM rel JOIN starts ON rel BETWEEN s AND s + 7 GROUP BY 1, 2, 3 HAVING count(*) >= 6),
days AS (
  SELECT r.site, r.day AS date_local, r.n_hours, coalesce(w.n, 0) AS valid_windows, CASE WHEN w.n >= 13 THEN w.m END AS mda8
  FROM (SELECT site, day, count(*) AS n_hours FROM rel GROUP BY 1, 2) r
  LEFT JOIN (SELECT site, day, count(*) AS n, max(v) AS m FROM windows GROUP BY 1, 2) w ON r.site = w.site AND r.day = w.day)"""

RESOLVED_SQL = f"""
{A.HOURLY_SQL},
by_monitor AS (SELECT site, date_local, local_hour, poc, count(*) AS m, min(ppb) AS ppb FROM hourly GROUP BY 1, 2, 3, 4),
resolved AS (
  SELECT site, date_local, local_hour, CAST(coalesce(sum(m) FILTER (m > 1), 0) AS BIGINT) AS duplicate_rows, count(*) FILTER (m = 1) AS valid_pocs,
         CASE WHEN count(*) FILTER (m = 1) = 0 THEN 'missing' WHEN count(*) FILTER (m = 1) > 1 THEN 'ambiguous' ELSE 'keep' END AS verdict,
         CASE WHEN count(*) FILTER (m = 1) = 1 THEN min(ppb) FILTER (m = 1) END AS ppb, CASE WHEN count(*) FILTER (m = 1) = 1 THEN min(poc) FILTER (m = 1) END AS poc
  FROM by_monitor GROUP BY 1, 2, 3)"""

QUERIES = {
    f.__name__: f
    for f in (classify_ledger, clean_rows, poc_resolution, poc_ledger_by_site, primary_first_substitution, duplicate_multiplicity, daily_mda8, target_day_hours, mda8_failed_days, daily_pocs_list, daily_reconciliation, first_hour_of_year)
}

ORACLES = {
    "classify_ledger": f"WITH {A.RAW_SQL} SELECT site, coalesce({RULES_SQL}, 'kept') AS reason, count(*) AS n_rows FROM raw_rows GROUP BY 1, 2",
    "clean_rows": f"""WITH {A.RAW_SQL} SELECT event_id, '01-' || lpad(CAST(site % 1000 AS VARCHAR), 3, '0') || '-0001' AS site_id, date_local, local_hour,
        CAST(trunc(value / 1000.0::DOUBLE * 1000) AS BIGINT) AS ppb FROM raw_rows WHERE {RULES_SQL} IS NULL""",
    "poc_resolution": f"WITH {RESOLVED_SQL} SELECT * FROM resolved",
    "poc_ledger_by_site": f"""WITH {RESOLVED_SQL} SELECT site, count(*) FILTER (verdict = 'missing') AS n_missing, count(*) FILTER (verdict = 'keep') AS n_keep,
        count(*) FILTER (verdict = 'ambiguous') AS n_ambiguous, CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows FROM resolved GROUP BY 1""",
    "primary_first_substitution": f"WITH {WINDOWS_SQL} SELECT site, date_local, local_hour, round(ppb, 6) AS ppb, from_primary FROM hours",
    "duplicate_multiplicity": f"WITH {A.HOURLY_SQL} SELECT m AS multiplicity, count(*) AS n_keys FROM (SELECT count(*) AS m FROM hourly GROUP BY site, date_local, local_hour, poc) GROUP BY 1",
    "daily_mda8": f"WITH {WINDOWS_SQL} SELECT site, date_local, n_hours, valid_windows, mda8 FROM days",
    "target_day_hours": f"""WITH {A.HOURLY_SQL},
        r AS (SELECT site, poc, CAST(date_local - CASE WHEN local_hour < 7 THEN 1 ELSE 0 END AS DATE) AS date_local, (local_hour + 17) % 24 + 7 AS rel, count(*) AS n FROM hourly GROUP BY 1, 2, 3, 4)
        SELECT site, poc, date_local, CAST(sum(n) AS BIGINT) AS n_rows, 24 - count(*) AS n_missing, count(*) FILTER (n > 1) AS n_repeated,
          CASE WHEN max(n) > 1 THEN 'repeated hour' WHEN count(*) < 24 THEN 'missing hour' ELSE 'exact' END AS verdict FROM r GROUP BY 1, 2, 3""",
    "mda8_failed_days": f"""WITH {WINDOWS_SQL}, spine AS (SELECT site, CAST(unnest(generate_series(min(date_local), max(date_local), INTERVAL 1 DAY)) AS DATE) AS date_local FROM days GROUP BY 1)
        SELECT s.site, s.date_local, coalesce(n_hours, 0) AS n_hours, coalesce(valid_windows, 0) AS valid_windows FROM spine s LEFT JOIN days d ON s.site = d.site AND s.date_local = d.date_local WHERE mda8 IS NULL""",
    "daily_pocs_list": f"WITH {WINDOWS_SQL} SELECT site, date_local, array_to_string(list_sort(list_distinct(flatten(list(pocs)))), ',') AS pocs FROM hours GROUP BY 1, 2",
    "daily_reconciliation": f"""WITH {WINDOWS_SQL}, o AS (
          SELECT site, date_local, mda8 + CASE day(date_local) % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.4::DOUBLE ELSE 2.0 END AS value, CASE WHEN day(date_local) % 5 = 0 THEN 2 ELSE 1 END AS n FROM days WHERE day(date_local) % 7 <> 0)
        SELECT d.site, d.date_local, mda8, round(value, 6) AS official,
          CASE WHEN n IS NULL THEN 'no official value' WHEN n > 1 THEN 'duplicate' WHEN mda8 IS NULL THEN 'no value' WHEN abs(mda8 - value) <= 1e-6 THEN 'exact' WHEN abs(mda8 - value) <= 0.5 THEN 'rounding' ELSE 'material' END AS agreement
        FROM days d LEFT JOIN o ON d.site = o.site AND d.date_local = o.date_local""",
    "first_hour_of_year": f"""WITH {A.HOURLY_SQL} SELECT site, max(f) AS year_first, count(*) AS n_rows
        FROM (SELECT site, first_value(ppb) OVER (PARTITION BY site, year(date_local) ORDER BY date_local, local_hour, poc, ppb) AS f FROM hourly) GROUP BY 1""",
}
