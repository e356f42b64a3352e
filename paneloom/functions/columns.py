"""Column expressions for dates, geography, thresholds and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paneloom.config import PanelConfig

EARTH_RADIUS_KM = 6371.0088


def period(date: Column, cfg: PanelConfig) -> Column:
    """early, transition or later by calendar year; null outside all three."""
    year = F.year(date)
    return F.when(year.between(*cfg.early), "early").when(year == cfg.transition, "transition").when(year.between(*cfg.later), "later")


def temperature_bin(value: Column, width: float) -> Column:
    """Lower edge of the bin that holds value."""
    return F.floor(value / width) * F.lit(width)


def elevated(value: Column, threshold: float) -> Column:
    return value > threshold


def calendar_day_365(date: Column) -> Column:
    """Day of a year without 29 February, which is null."""
    year, month = F.year(date), F.month(date)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    day = F.dayofyear(date) - (leap & (month > 2)).cast("int")
    return F.when((month == 2) & (F.dayofmonth(date) == 29), F.lit(None)).otherwise(day).cast("int")


def month_day(date: Column) -> Column:
    return F.month(date) * 100 + F.dayofmonth(date)


def in_season(date: Column, begin: Column, end: Column) -> Column:
    """Whether the month and day are in an inclusive season, which may wrap the year's end."""
    md = month_day(date)
    return F.when(begin <= end, md.between(begin, end)).otherwise((md >= begin) | (md <= end))


def target_day(date: Column, hour: Column, first_hour: int = 7) -> Column:
    """The day whose windows an hour can be in: days run from first_hour to before it."""
    return F.date_sub(date, (hour < first_hour).cast("int"))


def relative_hour(hour: Column, first_hour: int = 7) -> Column:
    """Hours since midnight of the target day."""
    return (hour + 24 - first_hour) % 24 + first_hour


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(h))


def box_degrees(lat: Column, radius_km: float) -> tuple[Column, Column]:
    """Half the height and width, in degrees, of a box that holds the circle."""
    return F.lit(radius_km / 110.574), F.lit(radius_km) / (111.320 * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.1)))


def truncated_ppb(ppm: Column) -> Column:
    """ppm to whole ppb, toward zero."""
    return (ppm * 1000).cast("long")


def tenths(value: Column) -> Column:
    return F.when(value != -9999, value / 10.0)


def join_sorted(values: Column) -> Column:
    """Sorted distinct values that are not blank, joined by commas."""
    return F.array_join(F.array_sort(F.filter(F.array_distinct(values), lambda x: x != "")), ",")


def relation_to_zero(lower: Column, upper: Column) -> Column:
    return F.when(lower > 0, "above zero").when(upper < 0, "below zero").otherwise("includes zero")


def component_relation(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    return F.when(F.least(F.abs(a), F.abs(b)) <= tolerance, "effectively zero").when(F.signum(a) == F.signum(b), "reinforce").otherwise("oppose")


def direction_agreement(a: Column, b: Column) -> Column:
    """Whether two changes have one sign; a zero or a null can't be compared."""
    known = F.coalesce((a != 0) & (b != 0), F.lit(False))
    return F.when(~known, "not comparable").when(F.signum(a) == F.signum(b), "concordant").otherwise("differing")


def hash_proportion(text: Column) -> Column:
    """A number from 0 to 1 from the first 8 bytes of SHA-256."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(1000001).cast("decimal(20,0)")).cast("double") / 1000000.0


def site_identifier(state: Column, county: Column, site: Column) -> Column:
    """SS-CCC-NNNN, or null where a part has another form."""
    out = F.concat_ws("-", state, county, site)
    return F.when(out.rlike(r"^[0-9]{2}-[0-9]{3}-[0-9]{4}$"), out)


def redacted(url: Column) -> Column:
    """url without the values of its key and email parameters."""
    return F.regexp_replace(url, r"(?i)([?&](?:key|email)=)[^&]+", "$1REDACTED")
