"""From raw rows to daily maxima: classification, co-located monitors, moving means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.config import PanelConfig
from paneloom.functions import columns as C


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does. A null condition is not met."""
    out = None
    for name, bad in rules:
        bad = F.coalesce(bad, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def classified(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    return rows.withColumn("reason", first_reason(rules))


def ledger(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by reason; those that passed count as kept."""
    return rows.groupBy(*keys, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_rows"))


def resolve_monitors(hourly: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each site-hour with its verdict.

    A monitor (poc) that reports an hour more than once is not trusted there. One trusted
    monitor is kept, several are ambiguous, none is missing. The sums by monitor reduce
    the rows before the site-hours are shuffled.
    """
    by_monitor = hourly.groupBy(*keys, "poc").agg(F.count("*").alias("m"), F.min("ppb").alias("ppb"))
    single = F.col("m") == 1
    by_hour = by_monitor.groupBy(*keys).agg(
        F.sum(F.when(~single, F.col("m")).otherwise(0)).alias("duplicate_rows"),
        F.sum(single.cast("long")).alias("valid_pocs"),
        F.min(F.when(single, F.col("ppb"))).alias("single_ppb"),
        F.min(F.when(single, F.col("poc"))).alias("single_poc"),
    )
    verdict = F.when(F.col("valid_pocs") == 0, "missing").when(F.col("valid_pocs") > 1, "ambiguous").otherwise("keep")
    keep = F.col("valid_pocs") == 1
    return by_hour.select(*keys, "duplicate_rows", "valid_pocs", verdict.alias("verdict"), F.when(keep, F.col("single_ppb")).alias("ppb"), F.when(keep, F.col("single_poc")).alias("poc"))


def primary_first(hourly: DataFrame, keys: list[str], primary: str) -> DataFrame:
    """The primary monitor's value, else the mean of the others; duplicated monitors don't count."""
    by_monitor = hourly.groupBy(*keys, "poc").agg(F.count("*").alias("m"), F.min("ppb").alias("ppb")).where("m = 1")
    first = F.max(F.when(F.col("poc") == primary, F.col("ppb")))
    rest = F.avg(F.when(F.col("poc") != primary, F.col("ppb")))
    return by_monitor.groupBy(*keys).agg(F.coalesce(first, rest).alias("ppb"), first.isNotNull().alias("from_primary"), F.collect_list("poc").alias("pocs"))


def multiplicity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur how often."""
    return rows.groupBy(*keys).count().groupBy(F.col("count").alias("multiplicity")).agg(F.count("*").alias("n_keys"))


def daily_windows(hours: DataFrame, site: str, cfg: PanelConfig) -> DataFrame:
    """One row for each site and day: valid windows and the largest window mean.

    An hour belongs to one target day, so a single grouping brings a day's hours together;
    windows are taken from a map of them, which also finds windows whose first hour is
    missing. A window needs min_hours values and is the mean without its fraction; a day
    needs min_windows windows, else its value is null.
    """
    day = C.target_day(F.col("date_local"), F.col("local_hour"), cfg.first_hour)
    hours = hours.where(F.col("ppb").isNotNull() & ~F.isnan("ppb")).select(site, day.alias("day"), C.relative_hour(F.col("local_hour"), cfg.first_hour).alias("rel"), "ppb")
    days = hours.groupBy(site, "day").agg(F.map_from_entries(F.collect_list(F.struct("rel", "ppb"))).alias("by_hour"), F.count("*").alias("n_hours"))

    def window(start: Column) -> Column:
        values = F.filter(F.transform(F.sequence(start, start + cfg.window_hours - 1), lambda k: F.try_element_at("by_hour", k)), lambda v: v.isNotNull())
        mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
        return F.when(F.size(values) >= cfg.min_hours, F.floor(mean).cast("double"))

    starts = F.sequence(F.lit(cfg.first_hour), F.lit(23))
    days = days.withColumn("windows", F.filter(F.transform(starts, window), lambda w: w.isNotNull()))
    n = F.size("windows")
    return days.select(site, F.col("day").alias("date_local"), "n_hours", n.cast("long").alias("valid_windows"), F.when(n >= cfg.min_windows, F.array_max("windows")).alias("mda8"))


def hour_checks(hours: DataFrame, keys: list[str], cfg: PanelConfig) -> DataFrame:
    """How far each target day of keys has exactly its 24 hours, whatever their values, and finite ones.

    missing and repeated list relative hours in order; rows whose hour is null or not of a
    day count in n_unknown, on their own date. verdict is the first of: unknown hour,
    repeated hour, not finite, missing hour, exact. A null value is an hour without one, not
    a missing hour. Rows of an hour are counted first, so a day gathers at most 25.
    """
    known = F.coalesce(F.col("local_hour").between(0, 23), F.lit(False))
    day = F.when(known, C.target_day(F.col("date_local"), F.col("local_hour"), cfg.first_hour)).otherwise(F.col("date_local"))
    rel = F.when(known, C.relative_hour(F.col("local_hour"), cfg.first_hour).cast("int"))
    strange = F.col("ppb").isNotNull() & (F.isnan("ppb") | (F.abs("ppb") == float("inf")))
    by_hour = hours.select(*keys, day.alias("_day"), rel.alias("_rel"), strange.alias("_strange")).groupBy(*keys, "_day", "_rel").agg(F.count("*").alias("_n"), F.count_if("_strange").alias("_strange"))
    days = by_hour.groupBy(*keys, F.col("_day").alias("date_local")).agg(
        F.sum("_n").alias("n_rows"),
        F.array_except(F.sequence(F.lit(cfg.first_hour), F.lit(cfg.first_hour + 23)), F.collect_list("_rel")).alias("missing"),
        F.sort_array(F.collect_list(F.when((F.col("_n") > 1) & F.col("_rel").isNotNull(), F.col("_rel")))).alias("repeated"),
        F.coalesce(F.sum(F.when(F.col("_rel").isNull(), F.col("_n"))), F.lit(0)).alias("n_unknown"),
        F.sum("_strange").alias("n_not_finite"),
    )
    verdict = (
        F.when(F.col("n_unknown") > 0, "unknown hour").when(F.size("repeated") > 0, "repeated hour").when(F.col("n_not_finite") > 0, "not finite")
        .when(F.size("missing") > 0, "missing hour").otherwise("exact")
    )
    return days.withColumn("verdict", verdict)


def day_spine(days: DataFrame, site: str) -> DataFrame:
    """Every day between a site's first and last, with what is known of it."""
    span = days.groupBy(site).agg(F.min("date_local").alias("lo"), F.max("date_local").alias("hi"))
    spine = span.select(site, F.explode(F.sequence("lo", "hi")).alias("date_local"))
    return spine.join(days, [site, "date_local"], "left")


def reconciled(days: DataFrame, official: DataFrame, keys: list[str], *, exact: float = 1e-6, rounding: float = 0.5) -> DataFrame:
    """Compares daily values with official ones; keys that the official rows repeat are duplicates."""
    other = official.groupBy(*keys).agg(F.count("*").alias("n_official"), F.min("value").alias("official"))
    diff = F.abs(F.col("mda8") - F.col("official"))
    kind = (
        F.when(F.col("n_official").isNull(), "no official value").when(F.col("n_official") > 1, "duplicate").when(F.col("mda8").isNull(), "no value")
        .when(diff <= exact, "exact").when(diff <= rounding, "rounding").otherwise("material")
    )
    return days.join(other, keys, "left").withColumn("agreement", kind)


def first_by_year(hours: DataFrame, site: str, value: str) -> DataFrame:
    """The value of each site's first hour in a year, applied to its year."""
    first = Window.partitionBy(site, F.year("date_local")).orderBy("date_local", "local_hour", "poc", value)
    return hours.withColumn("year_first", F.first(value).over(first))
