"""Checks of rows before they are fitted or published, as counts in one pass, and verdicts from thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.tables import quantiles

#: Fixed thresholds of the fit's diagnostics: caution over the first, serious concern over the second.
VARIANCE_RATIO, LAG1, CONDITION = (2.0, 4.0), (0.1, 0.3), (1e4, 1e6)
#: The share of failed attempts over which a bootstrap is unstable.
UNSTABLE = 0.05
#: Failure classes and the words that tell them, in order of precedence.
FAILURES = (
    ("support_failure", ("support",)),
    ("rank_failure", ("rank",)),
    ("conditioning_problem", ("condition",)),
    ("solver_failure", ("solve",)),
    ("serialization_problem", ("json", "serial", "checkpoint")),
    ("resource_exhaustion", ("memory", "resource")),
)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def counted(rows: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, check, n_bad): rows that each check finds, all in one pass. A null finding is none."""
    found = rows.groupBy(*keys).agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in checks.items()])
    return found.unpivot(list(keys), list(checks), "check", "n_bad")


def required(checks: DataFrame) -> None:
    """An error that names the checks which found something; checks are a bounded report."""
    if bad := [f"{r['check']}: {r['n_bad']}" for r in checks.where("n_bad > 0").orderBy("check").collect()]:
        raise ValueError("; ".join(bad))


def model_frame_checks(rows: DataFrame, outcome: str) -> DataFrame:
    """What a fit must not have: missing or infinite values, other periods, sites in two regions or without one of the periods, no rows."""
    numbers = [F.col(c).cast("double") for c in ("tmax_c", "day_of_year", outcome)]
    names = [F.col(c) for c in ("site_id", "climate_region", "period")]
    infinite = any_of([F.isnan(c) | (F.abs(c) == float("inf")) for c in numbers])
    by_row = counted(rows, {
        "missing values": any_of([c.isNull() for c in (*names, *numbers)]),
        "values not finite": infinite,
        "other periods": ~F.col("period").isin("early", "later"),
    })
    sites = rows.groupBy("site_id").agg(F.count_distinct("climate_region").alias("regions"), F.count_distinct(F.when(F.col("period").isin("early", "later"), F.col("period"))).alias("periods"))
    by_site = counted(sites, {"sites in several regions": F.col("regions") > 1, "sites without a period": F.col("periods") < 2})
    empty = rows.limit(1).agg((F.count("*") == 0).cast("long").alias("n_bad")).select(F.lit("no rows").alias("check"), "n_bad")
    return by_row.unionByName(by_site).unionByName(empty)


def site_period_checks(burden: DataFrame) -> DataFrame:
    """Site periods that contradict themselves: counts, shares, names that repeat, periods without their pair."""
    share = F.abs(F.col("share") - F.col("n_elevated") / F.when(F.col("n_valid") > 0, F.col("n_valid")))
    by_row = counted(burden, {
        "no valid day": F.col("n_valid") <= 0,
        "more elevated than valid days": (F.col("n_elevated") < 0) | (F.col("n_elevated") > F.col("n_valid")),
        "share is not the ratio": share > 1e-15,
        "other periods": ~F.col("period").isin("early", "later"),
    })
    keys = burden.groupBy("site_id", "period").agg(F.count("*").alias("n"))
    sites = keys.groupBy("site_id").agg(F.max("n").alias("n"), F.count("*").alias("periods"))
    return by_row.unionByName(counted(sites, {"site periods that repeat": F.col("n") > 1, "sites without a period": F.col("periods") < 2}))


def descriptive_checks(rows: DataFrame, outcome: str, threshold: float, flag: str | None = None) -> DataFrame:
    """What rows of a descriptive summary must not have: missing or infinite values, other periods, a flag that is not the outcome over the threshold."""
    value = F.col(outcome).cast("double")
    checks = {
        "missing values": any_of([F.col(c).isNull() for c in ("site_id", "climate_region", "period")]) | value.isNull(),
        "other periods": ~F.col("period").isin("early", "later"),
        "values not finite": F.isnan(value) | (F.abs(value) == float("inf")),
    }
    if flag:
        if rows.schema[flag].dataType.typeName() != "boolean":
            raise ValueError(f"{flag} is no boolean")
        checks["flag is not the comparison"] = F.col(flag).isNull() | (F.col(flag) != (value > threshold))
    return counted(rows, checks)


def file_stamps(names: DataFrame, listing: DataFrame, manifest: DataFrame, year: int) -> DataFrame:
    """Each file (file) with its day in the listing (file, created), the manifest's stamps (file, retrieved, modified) and the listing's lag after the year.

    A file that either does not have, or has twice, is an error.
    """
    once = {"listing": listing.groupBy("file").agg(F.max("created").alias("created"), F.count("*").alias("_listed")), "manifest": manifest.groupBy("file").agg(F.max("retrieved").alias("retrieved"), F.max("modified").alias("modified"), F.count("*").alias("_recorded"))}
    joined = names.select("file").join(once["listing"], "file", "left").join(once["manifest"], "file", "left")
    bad = F.when(F.coalesce("_listed", F.lit(0)) != 1, "listing").when(F.coalesce("_recorded", F.lit(0)) != 1, "manifest")
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("not once in the "), bad, F.lit(": "), "file"))).otherwise(F.col("file"))
    return joined.select(checked.alias("file"), "created", "retrieved", "modified", lag_days(F.col("created"), year).alias("lag_days"))


def interval_checks(intervals: DataFrame, scopes: DataFrame, quantities: Sequence[str]) -> DataFrame:
    """Interval rows that are out of order, not finite, repeated or missing for a scope (scope) and quantity."""
    ends = [F.col(c) for c in ("lower", "median", "upper")]
    by_row = counted(intervals, {
        "not finite": any_of([c.isNull() | F.isnan(c) for c in ends]),
        "lower over upper": F.col("lower") > F.col("upper"),
        "median outside": ~F.col("median").between(F.col("lower"), F.col("upper")),
    })
    keys = intervals.groupBy("scope", "quantity").agg(F.count("*").alias("n"))
    wanted = scopes.select("scope").distinct().withColumn("quantity", F.explode(F.array(*[F.lit(q) for q in quantities])))
    joined = wanted.join(keys, ["scope", "quantity"], "full")
    return by_row.unionByName(counted(joined, {"missing": F.col("n").isNull(), "repeated": F.col("n") > 1}))


def draw_checks(drawn: DataFrame, sites: DataFrame) -> DataFrame:
    """(replicate, climate_region, check, n_bad) of draws: as many as sites, labels of their own and of the right form, known sources."""
    label = F.format_string("%s::draw-%04d::%s", "climate_region", "draw_index", "source_site")
    known = sites.select("climate_region", F.col("site_id").alias("source_site")).distinct().withColumn("_known", F.lit(True))
    joined = drawn.join(known, ["climate_region", "source_site"], "left")
    found = joined.groupBy("replicate", "climate_region").agg(
        F.count("*").alias("n"), F.count_distinct("bootstrap_site").alias("labels"), F.count_distinct("draw_index").alias("places"),
        F.count_if(F.col("bootstrap_site") != label).alias("labels of another form"), F.count_if(F.col("_known").isNull()).alias("unknown sources"),
    )
    sizes = sites.select("climate_region", "site_id").distinct().groupBy("climate_region").agg(F.count("*").alias("size"))
    found = found.join(sizes, "climate_region", "left").withColumns({"draws too many or too few": F.abs(F.col("n") - F.coalesce("size", F.lit(0))), "labels that repeat": F.col("n") - F.col("labels"), "places that repeat": F.col("n") - F.col("places")})
    return found.unpivot(["replicate", "climate_region"], ["draws too many or too few", "labels that repeat", "places that repeat", "labels of another form", "unknown sources"], "check", "n_bad")


def inventory(rows: DataFrame, fields: Sequence[str], year: str, region: str, nation: str) -> DataFrame:
    """What each field holds: type, missing rows, values, and the years, regions and nations in which it is there.

    Fields become rows and equal ones are counted before anything is distinct, so the rows
    are read once for all fields.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f")
    cells = rows.select(pair, F.col(year).alias("_year"), F.col(region).alias("_region"), F.col(nation).alias("_nation")).groupBy("f.field", "f.value", "_year", "_region", "_nation").agg(F.count("*").alias("n"))
    there = F.col("value").isNotNull()
    found = cells.groupBy("field").agg(
        F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("n_missing"), F.count_distinct("value").alias("n_values"), F.min(F.when(there, F.col("_year"))).alias("first_year"), F.max(F.when(there, F.col("_year"))).alias("last_year"),
        F.count_distinct(F.when(there, F.col("_year"))).alias("n_years"), F.count_distinct(F.when(there, F.col("_region"))).alias("n_regions"), F.count_distinct(F.when(there, F.col("_nation"))).alias("n_nations"),
    )
    kind = F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(rows.schema[f].dataType.simpleString()))])
    return found.select("field", kind[F.col("field")].alias("data_type"), *[c for c in found.columns if c != "field"])


def failure_class(message: Column) -> Column:
    """The first class of which a word is in the message, in any case."""
    text, out = F.lower(F.coalesce(message, F.lit(""))), None
    for name, words in FAILURES:
        found = any_of([F.contains(text, F.lit(w)) for w in words])
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("other")


def failure_rates(attempts: DataFrame, *keys: str) -> DataFrame:
    """Attempts (success, message) by keys: failures, their share, whether that is unstable, and how many of each class."""
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    classes = attempts.withColumn("_class", F.when(failed, failure_class(F.col("message"))))
    names = [n for n, _ in FAILURES] + ["other"]
    found = classes.groupBy(*keys).agg(F.count("*").alias("n_attempts"), F.count("_class").alias("n_failures"), *[F.count_if(F.col("_class") == n).alias(n) for n in names])
    share = F.col("n_failures") / F.col("n_attempts")
    return found.select(*keys, "n_attempts", "n_failures", F.round(share, 6).alias("failure_share"), F.when(share > UNSTABLE, "inferentially_unstable").otherwise("acceptable").alias("verdict"), *names)


def quantile_error(values: DataFrame, probabilities: Sequence[float], *keys: str, digits: int = 6) -> DataFrame:
    """(keys, n, error at each probability): half the distance between the order statistics 1.96 standard errors of the rank away.

    values (value) has one row for each replicate, so a group's list is as long as the
    bootstrap.
    """
    lists = values.where("value is not null").groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("v")).withColumn("n", F.size("v").cast("long"))

    def at(p: Column) -> Column:
        place = p * (F.col("n") - 1)
        low, high = (F.get("v", f(place).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    out = []
    for i, p in enumerate(probabilities):
        far = F.least(F.lit(0.1), 1.96 * F.sqrt(F.col("n") * p * (1 - p)) / F.col("n"))
        out.append(F.round((at(F.least(F.lit(1.0), p + far)) - at(F.greatest(F.lit(0.0), p - far))) / 2, digits).alias(f"error_{i}"))
    return lists.select(*keys, "n", *out)


def contribution(component: Column, total: Column, component_ends: tuple[Column, Column], total_ends: tuple[Column, Column], least_total: float | None = None) -> tuple[Column, Column]:
    """A component's share of the total in percent, and why it is not given.

    It is not if the two have opposite signs, or if either interval holds zero, or while
    no least size of a total is set (least_total).
    """
    opposed = component * total < 0
    holds = [(low <= 0) & (high >= 0) for low, high in (total_ends, component_ends)]
    reason = F.when(opposed, "components oppose").when(holds[0], "total interval includes zero").when(holds[1], "component interval includes zero")
    reason = reason.otherwise("no least total is set") if least_total is None else reason.when(F.abs(total) < least_total, "total too small")
    return F.when(reason.isNull(), 100 * component / total), reason


def graded(value: Column, bounds: tuple[float, float]) -> Column:
    return F.when(value > bounds[1], "serious concern").when(value > bounds[0], "caution").otherwise("acceptable")


def diagnostic_classes(variance_ratio: Column, lag1: Column, condition: Column, n_outside: Column) -> Column:
    """An array of (diagnostic, value, verdict) from four numbers of a fit."""
    rows = [
        ("residual variance by fitted decile", variance_ratio, graded(variance_ratio, VARIANCE_RATIO)),
        ("lag-1 residual correlation of sites", lag1, graded(F.abs(lag1), LAG1)),
        ("conditioning", condition, graded(condition, CONDITION)),
        ("fitted values outside the observed range", n_outside.cast("double"), F.when(n_outside > 0, "caution").otherwise("acceptable")),
    ]
    return F.array(*[F.struct(F.lit(n).alias("diagnostic"), v.alias("value"), c.alias("verdict")) for n, v, c in rows])


def design_size(rows: DataFrame, *, t_columns: int = 4, s_columns: int = 6) -> DataFrame:
    """Columns and bytes that a dense design, and a sparse one, of these rows would have."""
    found = rows.agg(F.count("*").alias("n_rows"), F.count_distinct("site_id").alias("n_sites"), F.count_distinct("climate_region").alias("n_regions"))
    n, width = F.col("n_rows"), F.col("n_sites") + F.col("n_regions") * (1 + 2 * (t_columns + s_columns))
    # A row has its site, its period, its basis columns and at most the interactions of one of them.
    entries = n * (3 + t_columns + s_columns)
    return found.select("*", width.alias("n_columns"), (n * width * 8).alias("dense_bytes"), entries.alias("sparse_entries"), (entries * 12 + (n + 1) * 4).alias("sparse_bytes"))


def completeness(fractions: DataFrame, monitors: DataFrame, year: int) -> DataFrame:
    """One row on a year's data: sites by how much of their season they have, monitors by certification, and the lag of the last change.

    fractions (site_id, fraction) has one row for each site with a complete day, monitors
    (certification, changed) one for each monitor record.
    """
    sites = fractions.agg(F.count("*").alias("n_sites"), F.count_if(F.col("fraction") >= 0.75).alias("n_sites_75"), F.count_if(F.col("fraction") >= 0.9).alias("n_sites_90"))
    ends = quantiles(fractions, "fraction", (0.5, 0.0)).agg(F.round(F.max(F.col("q")[0]), 6).alias("median_fraction"), F.round(F.max(F.col("q")[1]), 6).alias("least_fraction"))
    codes = monitors.groupBy(F.coalesce(F.nullif("certification", F.lit("")), F.lit("blank")).alias("code")).agg(F.count("*").alias("n"), F.max("changed").alias("changed"))
    listed = codes.agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "code", F.col("n").cast("string")))), ",").alias("certification"), F.max("changed").alias("last_change"),
    )
    return sites.crossJoin(ends).crossJoin(listed).withColumn("lag_days", lag_days(F.col("last_change"), year))  # one row each


def separation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Whether site effects and one column can tell the outcome (0 or 1) apart, by region.

    With an effect for each site, a slope separates a region exactly if it separates every
    site that varies, in one direction: all of a site's zeros lie on one side of its ones
    (complete), or touch them at one value (quasi). Sites that do not vary have no finite
    effect and are counted. A fit on more columns notices separation by effects that run away.
    """
    one = F.col(y) == 1
    sites = rows.groupBy("climate_region", "site_id").agg(
        *[f(F.when(c, F.col(x))).alias(n) for n, f, c in (("lo0", F.min, ~one), ("hi0", F.max, ~one), ("lo1", F.min, one), ("hi1", F.max, one))], F.count_if(one).alias("n1"), F.count("*").alias("n"),
    )
    varies = (F.col("n1") > 0) & (F.col("n1") < F.col("n"))

    def every(condition: Column) -> Column:
        return F.bool_and(F.when(varies, condition))

    found = sites.groupBy("climate_region").agg(
        F.count_if(F.col("n1") == 0).alias("all_zero_sites"), F.count_if(F.col("n1") == F.col("n")).alias("all_one_sites"), F.count_if(varies).alias("varying_sites"),
        (every(F.col("hi0") < F.col("lo1")) | every(F.col("hi1") < F.col("lo0"))).alias("complete"), (every(F.col("hi0") <= F.col("lo1")) | every(F.col("hi1") <= F.col("lo0"))).alias("quasi"),
    )
    status = F.when(F.col("varying_sites") == 0, "no site varies").when(F.col("complete"), "complete").when(F.col("quasi"), "quasi").otherwise("none")
    return found.select("climate_region", "all_zero_sites", "all_one_sites", "varying_sites", status.alias("separation"))


def coded(rows: DataFrame, codes: DataFrame, column: str, *, rejected: str, excluded: str, terms: Sequence[str]) -> DataFrame:
    """rows with reason, is_request and is_related, from a code table (code, description, kind).

    column holds codes joined by commas; blanks pass. reason: a code is not in the table,
    or its kind is rejected. is_request: a code's kind is excluded. is_related: a code that
    is not rejected has one of terms in its description. The table becomes one map.
    """
    entry = F.map_from_entries(F.collect_list(F.struct("code", F.struct("kind", F.lower("description").alias("description"))))).alias("_codes")
    each = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    joined = rows.crossJoin(codes.agg(entry)).withColumn("_each", each)  # one row of codes

    def some(condition) -> Column:
        return F.exists("_each", lambda c: F.coalesce(condition(F.try_element_at("_codes", c)), F.lit(False)))

    known = F.forall("_each", lambda c: F.try_element_at("_codes", c).isNotNull())
    reason = F.when(~known, "unknown code").when(some(lambda e: e["kind"] == rejected), "rejected code")
    related = some(lambda e: (e["kind"] != rejected) & any_of([F.contains(e["description"], F.lit(t)) for t in terms]))
    return joined.withColumns({"reason": reason, "is_request": some(lambda e: e["kind"] == excluded), "is_related": related}).drop("_codes", "_each")


def lag_days(date: Column, year: int) -> Column:
    return F.datediff(date, F.make_date(F.lit(year), F.lit(12), F.lit(31)))


def fitted_classes(fitted: DataFrame, deciles: DataFrame, lags: DataFrame, condition: DataFrame, outcome: str) -> DataFrame:
    """(diagnostic, value, verdict) of a fit: fitted rows, rows with resid by decile, lag-1 correlations and condition numbers."""
    spread = deciles.groupBy("decile").agg(F.var_samp("resid").alias("v")).agg((F.max("v") / F.min("v")).alias("ratio"))
    middle = quantiles(lags, "lag1", (0.5,)).agg(F.max(F.col("q")[0]).alias("lag1"))
    largest = condition.agg(F.max("condition").alias("condition"))
    ends = fitted.agg(F.min(outcome).alias("_lo"), F.max(outcome).alias("_hi"))
    outside = fitted.crossJoin(ends).agg(F.count_if((F.col("fitted") < F.col("_lo")) | (F.col("fitted") > F.col("_hi"))).alias("n_outside"))
    one = spread.crossJoin(middle).crossJoin(largest).crossJoin(outside)  # one row each
    rows = one.select(F.explode(diagnostic_classes(F.round("ratio", 6), F.round("lag1", 4), F.round("condition", 3), F.col("n_outside"))).alias("d"))
    return rows.select("d.diagnostic", "d.value", "d.verdict")


def region_diagnostics(fitted: DataFrame, fits: DataFrame, outcome: str, above: float) -> DataFrame:
    """Each region's rows, sites, rank, root mean square error, and fitted values below zero and above a bound."""
    error = F.col(outcome) - F.col("fitted")
    by_region = fitted.groupBy("climate_region").agg(F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.count_if(F.col("fitted") < 0).alias("n_negative"), F.count_if(F.col("fitted") > above).alias("n_above"), F.min("tmax_c").alias("tmax_lo"), F.max("tmax_c").alias("tmax_hi"))
    return by_region.join(fits.select("climate_region", "n_sites", "n_rows", "matrix_rank").distinct(), "climate_region")
