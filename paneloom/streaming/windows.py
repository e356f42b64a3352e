"""Moving means and daily maxima over a stream of hourly values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.config import PanelConfig


def moving_means(hours: DataFrame, cfg: PanelConfig = PanelConfig(), *, late: str = "24 hours") -> DataFrame:
    """Mean of each window of hours by site, without its fraction, once late rows can't come any more.

    hours has site, ts (the hour's begin) and ppb, one row for each hour. Windows with
    fewer than min_hours values are left out. The same plan runs on a batch.
    """
    if hours.isStreaming:
        hours = hours.withWatermark("ts", late)
    window = F.window("ts", f"{cfg.window_hours} hours", "1 hour")
    means = hours.where(F.col("ppb").isNotNull()).groupBy("site", window.alias("w")).agg(F.count("*").alias("n_hours"), F.floor(F.avg("ppb")).cast("double").alias("mean"))
    return means.where(F.col("n_hours") >= cfg.min_hours).select("site", F.col("w.start").alias("ts"), "n_hours", "mean")


def daily_maxima(hours: DataFrame, cfg: PanelConfig = PanelConfig(), *, late: str = "24 hours") -> DataFrame:
    """Largest mean of the windows that start from first_hour to 23 of a day; null for too few windows."""
    means = moving_means(hours, cfg, late=late).where(F.hour("ts") >= cfg.first_hour)
    day = F.window("ts", "1 day")
    out = means.groupBy("site", day.alias("d")).agg(F.count("*").alias("valid_windows"), F.max("mean").alias("top"))
    return out.select("site", F.to_date("d.start").alias("date_local"), "valid_windows", F.when(F.col("valid_windows") >= cfg.min_windows, F.col("top")).alias("mda8"))
