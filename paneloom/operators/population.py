"""Eligibility, common support, population variants and their audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from paneloom.config import PanelConfig
from paneloom.functions import columns as C
from paneloom.operators.tables import kept, ranked


def year_days(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def site_years(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Days of each site and year, and whether they are enough of the year."""
    out = panel.groupBy("site_id", "climate_region", "calendar_year").agg(F.count("*").alias("n_days"))
    coverage = F.col("n_days") / year_days(F.col("calendar_year"))
    return out.withColumn("coverage", coverage).withColumn("qualifies", F.col("coverage") >= cfg.min_coverage)


def site_balance(years: DataFrame, cfg: PanelConfig, assign_transition: str | None = None) -> DataFrame:
    """Qualifying years of each site in each period; the transition year may count as early or later."""
    year = F.col("calendar_year")
    early, later = year.between(*cfg.early), year.between(*cfg.later)
    early = early | (year == cfg.transition) if assign_transition == "early" else early
    later = later | (year == cfg.transition) if assign_transition == "later" else later
    q = F.col("qualifies")
    return years.groupBy("site_id", "climate_region").agg(F.count_if(q & early).alias("early_years"), F.count_if(q & later).alias("later_years"))


def balanced(balance: DataFrame, min_years: int) -> DataFrame:
    return balance.where((F.col("early_years") >= min_years) & (F.col("later_years") >= min_years))


def base_rows(panel: DataFrame, sites: DataFrame, assign_transition: str | None = None) -> DataFrame:
    """Rows of the given sites in either period, with a temperature and a region."""
    period = F.when(F.col("period") == "transition", F.lit(assign_transition)).otherwise(F.col("period"))
    rows = panel.withColumn("period", period).where("period is not null and tmax_c is not null and climate_region is not null")
    return rows.join(sites.select("site_id"), "site_id", "left_semi")


def support_counts(rows: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Rows of each region and temperature bin by period."""
    binned = rows.withColumn("bin", C.temperature_bin(F.col("tmax_c"), cfg.bin_width))
    counts = binned.groupBy("climate_region", "bin").agg(F.count_if(F.col("period") == "early").alias("n_early"), F.count_if(F.col("period") == "later").alias("n_later"))
    return counts.withColumn("supported", (F.col("n_early") >= cfg.min_days) & (F.col("n_later") >= cfg.min_days))


def supported_rows(rows: DataFrame, cfg: PanelConfig) -> DataFrame:
    bins = support_counts(rows, cfg).where("supported").select("climate_region", "bin")
    return rows.withColumn("bin", C.temperature_bin(F.col("tmax_c"), cfg.bin_width)).join(bins, ["climate_region", "bin"], "left_semi")


def support_flags(rows: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Every row with whether its bin is supported; the counts are joined, so no bin is one task's work."""
    binned = rows.withColumn("bin", C.temperature_bin(F.col("tmax_c"), cfg.bin_width))
    return binned.join(support_counts(rows, cfg).select("climate_region", "bin", "supported"), ["climate_region", "bin"])


def judged_additions(rows: DataFrame, primary: DataFrame, cfg: PanelConfig) -> DataFrame:
    """rows that are to join a fit on primary, with bin and verdict; only kept ones may.

    A row goes if no primary row of its region is in its bin, if its temperature is outside
    all of primary's, or if it is of a leap day, in this order. primary has bin.
    """
    bins = primary.select("climate_region", "bin").distinct().withColumn("_there", F.lit(True))
    ends = primary.agg(F.min("tmax_c").alias("_lo"), F.max("tmax_c").alias("_hi"))
    binned = rows.withColumn("bin", C.temperature_bin(F.col("tmax_c"), cfg.bin_width)).join(bins, ["climate_region", "bin"], "left").crossJoin(ends)  # one row
    leap = (F.month("date_local") == 2) & (F.dayofmonth("date_local") == 29)
    verdict = F.when(F.col("_there").isNull(), "outside support").when(~F.col("tmax_c").between(F.col("_lo"), F.col("_hi")), "outside bounds").when(leap, "leap day").otherwise("kept")
    return binned.withColumn("verdict", verdict).drop("_there", "_lo", "_hi")


def drop_leap_days(rows: DataFrame) -> DataFrame:
    return rows.where(~((F.month("date_local") == 2) & (F.dayofmonth("date_local") == 29)))


def retention(rows: DataFrame, cfg: PanelConfig, *, after_leap: bool = False, supported_sites: bool = False) -> DataFrame:
    """Retained share of each region by period, sites, and whether the region can be estimated.

    after_leap counts the numerator without leap days; supported_sites counts sites with
    supported rows instead of all.
    """
    flags = support_flags(rows, cfg)
    kept = F.col("supported")
    if after_leap:
        kept = kept & ~((F.month("date_local") == 2) & (F.dayofmonth("date_local") == 29))
    early, later = F.col("period") == "early", F.col("period") == "later"
    out = flags.groupBy("climate_region").agg(
        F.count_if(early).alias("early_rows"),
        F.count_if(later).alias("later_rows"),
        F.count_if(early & kept).alias("early_kept"),
        F.count_if(later & kept).alias("later_kept"),
        F.count_distinct(F.when(kept, F.col("site_id")) if supported_sites else F.col("site_id")).alias("n_sites"),
        F.count_distinct(F.when(F.col("supported"), F.col("bin"))).alias("n_bins"),
    )
    out = out.withColumns({f"{p}_share": F.round(F.when(F.col(f"{p}_rows") > 0, F.col(f"{p}_kept") / F.col(f"{p}_rows")), 9) for p in ("early", "later")})
    low = (F.col("early_kept") < cfg.min_retention * F.col("early_rows")) | (F.col("later_kept") < cfg.min_retention * F.col("later_rows"))
    reason = F.when(F.col("n_bins") == 0, "no supported bin").when(F.col("n_sites") < cfg.min_sites, "too few sites").when(low, "low retention").otherwise("estimable")
    return out.withColumn("verdict", reason)


def flow(rows: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows and distinct sites after each stage, in one pass; stages add up."""
    passed, aggs = F.lit(True), []
    for i, (_, keeps) in enumerate(stages):
        passed = passed & F.coalesce(keeps, F.lit(False))
        aggs += [F.count_if(passed).alias(f"r{i}"), F.count_distinct(F.when(passed, F.col("site_id"))).alias(f"s{i}")]
    cells = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(f"r{i}").alias("n_rows"), F.col(f"s{i}").alias("n_sites")) for i, (name, _) in enumerate(stages)])
    return rows.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")


def integrity(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Counts that should be zero, and totals, of a panel."""
    keys = panel.groupBy("site_id", "date_local").agg(F.count("*").alias("n"), F.count_distinct("climate_region").alias("regions"))
    dup = keys.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("extra_rows"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(F.col("regions") > 1).alias("keys_in_two_regions"))
    year = F.col("calendar_year")
    flags = year.between(*cfg.early).cast("int") + (year == cfg.transition).cast("int") + year.between(*cfg.later).cast("int")
    one = panel.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("site_id").alias("n_sites"),
        F.count_if(flags != 1).alias("rows_outside_one_period"),
        F.count_if(F.col("tmax_c").isNull()).alias("null_tmax"),
        F.count_if(F.col("ozone_mda8_ppb").isNull()).alias("null_outcome"),
        F.count_if(~((F.col("ozone_mda8_ppb") > cfg.threshold) == C.elevated(F.col("ozone_mda8_ppb"), cfg.threshold))).alias("flag_disagreements"),
    )
    return one.crossJoin(dup)  # one row each


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("value")).agg(F.count("*").alias("n_rows"))


def outcome_support(rows: DataFrame, cfg: PanelConfig) -> DataFrame:
    """For each region, sites whose outcome never, always or sometimes exceeds, over both periods."""
    e = C.elevated(F.col("ozone_mda8_ppb"), cfg.threshold).cast("int")
    sites = rows.groupBy("climate_region", "site_id").agg(F.min(e).alias("lo"), F.max(e).alias("hi"), F.sum(e).alias("ones"), F.count("*").alias("n"))
    return sites.groupBy("climate_region").agg(
        F.count_if(F.col("hi") == 0).alias("all_zero_sites"),
        F.count_if(F.col("lo") == 1).alias("all_one_sites"),
        F.count_if(F.col("lo") < F.col("hi")).alias("varying_sites"),
        F.sum("ones").alias("n_elevated"),
        F.sum("n").alias("n_rows"),
    )


def whole_quality_years(rows: DataFrame, cfg: PanelConfig, passes: Column) -> DataFrame:
    """Rows of other years, and of the quality year those site-years in which all rows pass; null fails."""
    bad = rows.where((F.col("calendar_year") == cfg.quality_year) & ~F.coalesce(passes, F.lit(False))).select("site_id", "calendar_year").distinct()
    return rows.join(bad, ["site_id", "calendar_year"], "left_anti")


def common_sites(rows: DataFrame) -> DataFrame:
    """Rows of sites that have both periods."""
    both = rows.groupBy("site_id").agg(F.count_distinct("period").alias("n")).where("n = 2").select("site_id")
    return rows.join(both, "site_id", "left_semi")


def without_affected(rows: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(affected.select(*keys).distinct(), keys, "left_anti")


@dataclass(frozen=True)
class Candidate:
    """Another population: rows where remove holds go, or all rows of keys that have such a row.

    With before, they go from the whole panel, and years and sites qualify anew.
    """

    name: str
    remove: Column
    keys: tuple[str, ...] = ()
    before: bool = False


#: What goes with a removed row: the row, its site's year, its site.
SCOPES = {(): 0, ("site_id", "calendar_year"): 1, ("site_id",): 2}


def candidate_audit(panel: DataFrame, flags: dict[str, Column], candidates: Sequence[Candidate], cfg: PanelConfig) -> DataFrame:
    """One row for each candidate: what its filter and then common support leave, beside the first candidate's sites.

    Candidates decide by flags, so rows are counted by site, year, period, bin and flags
    once, and only these counts are taken as often as there are candidates. site_years are
    those of the rows before support.
    """
    period = F.when(F.col("period").isin("early", "later") & F.col("tmax_c").isNotNull(), F.col("period"))
    cells = panel.withColumns(flags | {"period": period, "bin": C.temperature_bin(F.col("tmax_c"), cfg.bin_width)}).groupBy("site_id", "climate_region", "calendar_year", "period", "bin", *flags).agg(F.count("*").alias("n"))
    cells = kept(cells, "cells")

    def qualified(some: DataFrame, *extra: str) -> DataFrame:
        years = some.groupBy(*extra, "site_id", "calendar_year").agg(F.sum("n").alias("n")).where(F.col("n") / year_days(F.col("calendar_year")) >= cfg.min_coverage)
        count = {p: F.count_if(F.col("calendar_year").between(*ends)) for p, ends in (("early", cfg.early), ("later", cfg.later))}
        return years.groupBy(*extra, "site_id").agg(*[c.alias(p) for p, c in count.items()]).where((F.col("early") >= cfg.min_years) & (F.col("later") >= cfg.min_years)).select(*extra, "site_id")

    own = qualified(cells, "climate_region").select("site_id").distinct()
    base = cells.join(own.withColumn("_base", F.lit(True)), "site_id", "left").withColumn("_base", F.col("_base").isNotNull() & F.col("period").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(c.remove, F.lit(False)).alias("remove"), F.lit(SCOPES[c.keys]).alias("scope"), F.lit(c.before).alias("before")) for i, c in enumerate(candidates)]))
    source = base.select("*", each.alias("c")).select("site_id", "climate_region", "calendar_year", "period", "bin", "n", "_base", "c.*").where("before or _base")
    hits = {k: F.max("remove").over(Window.partitionBy("i", *k)) for k in SCOPES if k}
    gone = F.when(F.col("scope") == 1, hits["site_id", "calendar_year"]).when(F.col("scope") == 2, hits[("site_id",)]).otherwise(F.col("remove"))
    source = kept(source.withColumn("gone", gone), "candidate-cells")
    anew = qualified(source.where("before and not gone"), "i").withColumn("_anew", F.lit(True))
    pre = source.where("not gone and period is not null").join(anew, ["i", "site_id"], "left").where("_anew or not before")
    early, later = (F.when(F.col("period") == p, F.col("n")).otherwise(0) for p in ("early", "later"))
    bins = pre.groupBy("i", "climate_region", "bin").agg(F.sum(early).alias("e"), F.sum(later).alias("l"))
    flagged = pre.join(bins.select("i", "climate_region", "bin", ((F.col("e") >= cfg.min_days) & (F.col("l") >= cfg.min_days)).alias("supported")), ["i", "climate_region", "bin"])
    flagged = kept(flagged, "candidate-rows")
    s = F.col("supported")
    regions = flagged.groupBy("i", "climate_region").agg(
        F.sum(early).alias("e"), F.sum(later).alias("l"), F.sum(F.when(s, early)).alias("ek"), F.sum(F.when(s, later)).alias("lk"), F.count_distinct("site_id").alias("sites"), F.count_if(s).alias("cells"),
    )
    poor = (F.col("cells") == 0) | (F.col("sites") < cfg.min_sites) | (F.col("ek") < cfg.min_retention * F.col("e")) | (F.col("lk") < cfg.min_retention * F.col("l"))
    regions = regions.groupBy("i").agg(F.count_if(F.coalesce(poor, F.lit(True))).alias("regions_not_estimable"))
    sites = flagged.where(s).groupBy("i", "site_id").agg(F.count_distinct("period").alias("p"))
    first = sites.where("i = 0").select("site_id", F.lit(True).alias("_first"))
    n_first = first.agg(F.count("*").alias("n_first"))
    sites = sites.join(first, "site_id", "left").groupBy("i").agg(F.count("*").alias("final_sites"), F.count_if(F.col("p") == 2).alias("sites_in_both"), F.count("_first").alias("_shared"))
    rows = flagged.groupBy("i").agg(
        F.sum("n").alias("pre_rows"), F.count_distinct("site_id", "calendar_year").alias("site_years"), F.sum(F.when(s, F.col("n")).otherwise(0)).alias("final_rows"), F.sum(F.when(s, early).otherwise(0)).alias("early_rows"),
        F.sum(F.when(s, later).otherwise(0)).alias("later_rows"), F.sum(F.when(s & (F.col("calendar_year") == cfg.quality_year), F.col("n")).otherwise(0)).alias("quality_rows"),
    )
    names = panel.sparkSession.createDataFrame([(i, c.name) for i, c in enumerate(candidates)], "i int, candidate string")
    input_ = source.groupBy("i").agg(F.sum("n").alias("input_rows"), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("removed_rows"))
    counts = ["input_rows", "removed_rows", "pre_rows", "final_rows", "early_rows", "later_rows", "quality_rows", "site_years", "final_sites", "sites_in_both", "_shared", "regions_not_estimable"]
    out = names.join(input_, "i", "left").join(rows, "i", "left").join(sites, "i", "left").join(regions, "i", "left").fillna(0, counts).crossJoin(n_first)  # one row
    return out.select("candidate", *[c for c in counts if c != "_shared"], (F.col("n_first") - F.col("_shared")).alias("sites_lost"), (F.col("final_sites") - F.col("_shared")).alias("sites_added"))


def set_difference(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Keys of one side only, with the side's name."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(names[0])).unionByName(
        right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(names[1]))
    )


def identity(rows: DataFrame, *columns: str) -> DataFrame:
    """A fingerprint of a set of rows that their order and partitions do not change."""
    h = F.xxhash64(*columns).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("n_rows"), F.sum(h).cast("string").alias("hash_sum"), F.bit_xor(F.xxhash64(*columns)).alias("hash_xor"))


def panel_rows(panel: DataFrame) -> DataFrame:
    """panel with panel_row, its place in order of site and date."""
    return ranked(panel, "site_id", "date_local", name="panel_row")


def gathered(numbered: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """columns of the rows of a numbered panel (panel_row) at given places; a place that the panel has not is an error."""
    there = F.lit(True).alias("_there")
    found = places.select("panel_row").join(numbered.select("panel_row", *columns, there), "panel_row", "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.lit("a place outside the panel"))).otherwise(F.col("panel_row"))
    return found.withColumn("panel_row", checked).drop("_there")


def fingerprint(*columns: str) -> list[Column]:
    """Metrics of rows that neither their order nor their partitions change: how many, and two sums of their hashes."""
    h = F.xxhash64(*columns)
    return [F.count("*").alias("n_rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor")]


def watched(rows: DataFrame, *columns: str) -> tuple[DataFrame, Callable[[], dict]]:
    """rows whose fingerprint is taken by the first job that reads them all, and a function that tells it then.

    The fingerprint costs no pass of its own; the function waits for a job, so it comes after one.
    """
    seen = Observation()
    return rows.observe(seen, *fingerprint(*columns)), lambda: dict(seen.get)


def verified(facts: dict, stored: dict) -> None:
    """An error if rows are not those whose facts were stored."""
    if changed := sorted(k for k in {*facts, *stored} if facts.get(k) != stored.get(k)):
        raise ValueError(f"the population is not the stored one: {', '.join(f'{k} is {facts.get(k)}, was {stored.get(k)}' for k in changed)}")


def named_identity(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """name and one SHA-256 of the rows' fingerprint under it."""
    found = identity(rows, *columns)
    return found.select(F.lit(name).alias("population"), "n_rows", F.sha2(F.concat_ws("|", F.lit(name), *[F.col(c).cast("string") for c in ("n_rows", "hash_sum", "hash_xor")]), 256).alias("sha256"))
