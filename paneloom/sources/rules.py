"""Rules on raw rows of measurement and weather files, each a column over the file's own column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions import columns as C

# Fixed values of the two file formats.
PARAMETER, NAME, UNIT = "44201", "Ozone", "Parts per million"
DAILY_DURATION, DAILY_STANDARD = "8-HR RUN AVG BEGIN HOUR", "Ozone 8-hour 2015"
METHODS = ("FRM", "FEM")
EVENTS_KEPT = ("None", "Included")
MEASUREMENT_FLAGS, QUALITY_FLAGS, SOURCE_FLAGS = "BDHKLOPTW", "DGIKLMNORSTWXZ", "01267ABCDEFGHIKMNQRSTUWXZabdfmrsuz"
#: State codes that stand for no contiguous state.
NOT_CONTIGUOUS = (2, 3, 7, 14, 15, 43, 52)


def contiguous(state: Column) -> Column:
    """Whether a two-digit code is a contiguous state or the capital district; the codes go to 56."""
    number = F.when(state.rlike("^[0-9]{2}$"), state.cast("int"))
    return F.coalesce(number.between(1, 56) & ~number.isin(*NOT_CONTIGUOUS), F.lit(False))


def finite(text: Column) -> Column:
    """A number from text, null if it is none or not finite."""
    value = text.try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def is_daily_target() -> Column:
    """Whether a daily summary row is one of the compared standard."""
    wanted = {"Parameter Code": PARAMETER, "Sample Duration": DAILY_DURATION, "Pollutant Standard": DAILY_STANDARD, "Units of Measure": UNIT}
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & F.coalesce(F.col(name) == value, F.lit(False))
    return out


def keeps_events() -> Column:
    return F.coalesce(F.col("Event Type").isin(*EVENTS_KEPT), F.lit(False))


def daily_reason(least: int = 13) -> Column:
    """Why a daily summary row is not compared, null if it is."""
    count = F.col("Observation Count").try_cast("int")
    return (
        F.when(~is_daily_target(), "not the target").when(~contiguous(F.col("State Code")), "out of scope").when(~keeps_events(), "events excluded")
        .when(count.isNull(), "no count").when(finite(F.col("1st Max Value")).isNull(), "no value").when(count < least, "incomplete day")
    )


def daily_ppb() -> Column:
    """The day's value in whole ppb."""
    return C.truncated_ppb(finite(F.col("1st Max Value")))


def hourly_reason(code_reason: Column) -> Column:
    """Why an hourly row is not used, null if it is; code_reason is that of its qualifier."""
    target = F.lit(True)
    for name, value in {"Parameter Code": PARAMETER, "Parameter Name": NAME, "Units of Measure": UNIT}.items():
        target = target & F.coalesce(F.col(name) == value, F.lit(False))
    method = F.coalesce(F.col("Method Type").isin(*METHODS) & F.col("Method Code").rlike("^[0-9]{3}$"), F.lit(False))
    return (
        F.when(~target, "not the target").when(~contiguous(F.col("State Code")), "out of scope").when(~method, "method").when(code_reason.isNotNull(), code_reason)
        .when(finite(F.col("Sample Measurement")).isNull(), "no value")
    )


def identifier_reason() -> Column:
    """Which of a measurement row's identifiers has another form, null if none."""
    forms = {"State Code": "[0-9]{2}", "County Code": "[0-9]{3}", "Site Num": "[0-9]{4}", "Parameter Code": "[0-9]{5}", "POC": "[0-9]{1,2}"}
    out = None
    for name, form in forms.items():
        bad = ~F.coalesce(F.col(name).rlike(f"^{form}$"), F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def weather_form_reason() -> Column:
    """Which field of a daily weather row (columns as text) is malformed, null if none."""

    def flag(name: str, known: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(""))
        return (value != "") & ((F.length(value) != 1) | (F.instr(F.lit(known), value) == 0))

    date = F.try_to_timestamp("date", F.lit("yyyyMMdd"))
    time = F.coalesce("obs_time", F.lit(""))
    return (
        F.when(~F.coalesce(F.col("station").rlike("^[A-Za-z0-9_-]{11}$"), F.lit(False)), "station")
        .when(~F.coalesce(F.col("date").rlike("^[0-9]{8}$"), F.lit(False)) | date.isNull(), "date")
        .when(~F.coalesce(F.col("value").cast("string").rlike("^[+-]?[0-9]+$"), F.lit(False)), "value")
        .when(flag("q_flag", QUALITY_FLAGS), "quality flag").when(flag("m_flag", MEASUREMENT_FLAGS), "measurement flag").when(flag("s_flag", SOURCE_FLAGS), "source flag")
        .when((time != "") & ~time.rlike("^[0-9]{4}$"), "time")
    )


def file_report(rows: DataFrame, files: DataFrame, date: Column, year: int, reason: Column) -> DataFrame:
    """One row for each file: bytes, digest, rows, first and last day, rows out of its year or with a reason against them.

    rows have file, the path; files (name, bytes, sha256) include those without a row.
    """
    name = F.element_at(F.split("file", "/"), -1)
    found = rows.groupBy(name.alias("name")).agg(
        F.count("*").alias("n_rows"), F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.count_if(date.isNull() | (F.year(date) != year)).alias("n_other_year"), F.count_if(reason.isNotNull()).alias("n_rejected"),
    )
    out = files.join(found, "name", "left").fillna(0, ["n_rows", "n_other_year", "n_rejected"])
    verdict = F.when(F.col("n_rows") == 0, "empty").when(F.col("n_other_year") > 0, "out of year").when(F.col("n_rejected") > 0, "rejected rows").otherwise("valid")
    return out.withColumn("verdict", verdict)
