"""Season rules with precedence, season days and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions import columns as C


def last_rule(rules: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last in order."""
    others = [c for c in rules.columns if c not in (*keys, order)]
    best = F.max_by(F.struct(*others), F.col(order)).alias("r")
    return rules.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def resolve(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites with begin, end and scope of the most specific rule: site, then nation, then region; blanks are broader."""
    own = rules.where("rule_site <> ''").select(F.col("rule_site").alias("site_id"), F.struct("begin", "end").alias("_site"))
    nation = rules.where("rule_site = '' and rule_nation <> ''").select(F.col("rule_region").alias("climate_region"), F.col("rule_nation").alias("nation"), F.struct("begin", "end").alias("_nation"))
    region = rules.where("rule_site = '' and rule_nation = ''").select(F.col("rule_region").alias("climate_region"), F.struct("begin", "end").alias("_region"))
    found = sites.join(own, "site_id", "left").join(nation, ["climate_region", "nation"], "left").join(region, "climate_region", "left")
    rule = F.coalesce("_site", "_nation", "_region")
    scope = F.when(F.col("_site").isNotNull(), "site").when(F.col("_nation").isNotNull(), "nation").when(F.col("_region").isNotNull(), "region")
    return found.select(*sites.columns, rule["begin"].alias("begin"), rule["end"].alias("end"), scope.alias("scope"))


def season_days(rules: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Days in season for each rule and year, leap days and seasons over the year's end included."""
    years = rules.select("*", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("calendar_year"))
    dates = F.sequence(F.make_date("calendar_year", F.lit(1), F.lit(1)), F.make_date("calendar_year", F.lit(12), F.lit(31)))
    inside = F.filter(dates, lambda d: C.in_season(d, F.col("begin"), F.col("end")))
    return years.withColumn("season_days", F.size(inside).cast("long"))


def season_fraction(days: DataFrame, year_days: DataFrame) -> DataFrame:
    """Share of each site-year's season days that the panel has."""
    inside = days.where(C.in_season(F.col("date_local"), F.col("begin"), F.col("end")))
    seen = inside.groupBy("site_id", "calendar_year").agg(F.count_distinct("date_local").alias("n_days"))
    return year_days.join(seen, ["site_id", "calendar_year"], "left").withColumn("n_days", F.coalesce("n_days", F.lit(0))).withColumn("fraction", F.col("n_days") / F.col("season_days"))
