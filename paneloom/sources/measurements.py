"""Measurement archives as classified rows, daily values and availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.functions import columns as C
from paneloom.operators import audits
from paneloom.sources import files, rules

# Column names of the archives, as they are in the files.
PLACE = ["State Code", "County Code", "Site Num"]
HOURLY = [*PLACE, "Parameter Code", "POC", "Date Local", "Time Local", "Parameter Name", "Units of Measure", "Method Type", "Method Code", "Qualifier", "Sample Measurement"]
DAILY = [*PLACE, "Parameter Code", "POC", "Sample Duration", "Pollutant Standard", "Date Local", "Units of Measure", "Event Type", "Observation Count", "1st Max Value", "Date of Last Change"]
#: Kinds of qualifier codes that reject a value and that ask for its exclusion.
REJECTED, EXCLUDED = "Null Data Qualifier", "Request Exclusion"


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"site_id": C.site_identifier(*[F.col(c) for c in PLACE]), "date_local": F.try_to_timestamp("Date Local", F.lit("yyyy-MM-dd")).cast("date")})


def hourly(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """(site_id, date_local, local_hour, poc, ppb, reason, file) of all hourly rows; ppb is null where there is a reason.

    codes (code, description, kind) is the table of qualifiers.
    """
    rows = _placed(files.zipped_csv(spark, path, HOURLY))
    rows = audits.coded(rows, codes, "Qualifier", rejected=REJECTED, excluded=EXCLUDED, terms=("fire",)).withColumnRenamed("reason", "_code")
    hour = F.when(F.col("Time Local").rlike("^[0-9]{2}:00$"), F.substring("Time Local", 1, 2).cast("int"))
    form = F.when(F.col("is_ragged"), "fields").when(rules.identifier_reason().isNotNull(), "identifier").when(F.col("date_local").isNull() | hour.isNull() | (hour > 23), "time")
    reason = F.coalesce(form, rules.hourly_reason(F.col("_code")))
    ppb = F.when(reason.isNull(), C.truncated_ppb(rules.finite(F.col("Sample Measurement"))).cast("double"))
    return rows.select("site_id", "date_local", hour.alias("local_hour"), F.col("POC").alias("poc"), ppb.alias("ppb"), reason.alias("reason"), "file")


def daily(spark: SparkSession, path: str, least: int = 13) -> DataFrame:
    """(site_id, date_local, poc, value, changed, reason, file) of all daily summary rows; value in whole ppb."""
    rows = _placed(files.zipped_csv(spark, path, DAILY))
    form = F.when(F.col("is_ragged"), "fields").when(rules.identifier_reason().isNotNull(), "identifier").when(F.col("date_local").isNull(), "time")
    reason = F.coalesce(form, rules.daily_reason(least))
    return rows.select("site_id", "date_local", F.col("POC").alias("poc"), F.when(reason.isNull(), rules.daily_ppb()).cast("double").alias("value"), F.try_to_timestamp("Date of Last Change", F.lit("yyyy-MM-dd")).cast("date").alias("changed"), reason.alias("reason"), "file")


def available_days(days: DataFrame) -> DataFrame:
    """(site_id, date_local) with a complete daily row, once each."""
    return days.where("reason is null").select("site_id", "date_local").distinct()


def available_temperatures(weather: DataFrame, country: str = "US") -> DataFrame:
    """(station, date_local) with an accepted daily maximum, once each."""
    return weather.where(files.weather_reason(country).isNull()).select("station", "date_local").distinct()
