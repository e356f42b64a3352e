"""Whole-site bootstrap within regions: draws, materialisation and intervals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneloom.functions import columns as C
from paneloom.operators.tables import kept

DRAWS = "replicate int, climate_region string, source_site string, bootstrap_site string, draw_index int"


def replicate_seed(base: int, replicate: int, stream: str = "") -> int:
    return int(np.random.SeedSequence([base, replicate, *([zlib.crc32(stream.encode())] if stream else [])]).generate_state(1)[0])


def numbered(sites: DataFrame) -> DataFrame:
    """Distinct sites with their place in the region's order of names, from 0, and n, the region's sites.

    A region's names pass one task in order; stations of a region are thousands, not rows.
    """
    distinct = sites.select("climate_region", "site_id").distinct()
    region = Window.partitionBy("climate_region")
    place = F.row_number().over(region.orderBy("site_id")).cast("long") - 1
    return kept(distinct.select("climate_region", "site_id", place.alias("place"), F.count("*").over(region).alias("n")), "numbered-sites")


def _drawn(each: DataFrame, own: DataFrame) -> DataFrame:
    """Draws (replicate, climate_region, draw_index, place) with the names of the sites at those places."""
    named = each.join(own.select("climate_region", "place", F.col("site_id").alias("source_site")), ["climate_region", "place"])
    label = F.format_string("%s::draw-%04d::%s", "climate_region", "draw_index", "source_site")
    return named.select("replicate", "climate_region", "source_site", label.alias("bootstrap_site"), "draw_index")


def draw_places(sizes: dict[str, int], seed: int) -> Iterator[tuple[str, np.ndarray]]:
    """(region, places): as many sites of each region as it has, with replacement, from one generator."""
    rng = np.random.default_rng(seed)
    for region in sorted(sizes):
        yield region, rng.integers(0, sizes[region], size=sizes[region])


def draws(spark: SparkSession, sites: DataFrame, replicates: int | Sequence[int], base_seed: int, stream: str = "") -> DataFrame:
    """Draws of the replicates (their number, or which), made by replicate in parallel.

    Each has a generator of its own, by the seed, the stream and its number. Tasks know how
    many sites each region has; the names come by a join on their places.
    """
    own = numbered(sites)
    sizes = {r["climate_region"]: r["n"] for r in own.select("climate_region", "n").distinct().collect()}
    which = range(1, replicates + 1) if isinstance(replicates, int) else replicates

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for replicate in batch.column(0).to_pylist():
                for region, places in draw_places(sizes, replicate_seed(base_seed, replicate, stream)):
                    for at in range(0, len(places), 100_000):
                        some = places[at : at + 100_000]
                        yield pa.record_batch({"replicate": np.full(len(some), replicate, np.int32), "climate_region": pa.array([region] * len(some)), "draw_index": np.arange(at, at + len(some), dtype=np.int32), "place": some})

    each = spark.createDataFrame([(int(r),) for r in which], "replicate int").repartition(max(1, min(len(which), 64)))
    return _drawn(each.mapInArrow(make, "replicate int, climate_region string, draw_index int, place long"), own)


def arithmetic_draws(sites: DataFrame, replicates: int) -> DataFrame:
    """Draws from a formula that any engine can follow; for comparing engines."""
    own = numbered(sites)
    i, r = F.col("place"), F.col("replicate")
    each = own.select("climate_region", "place", "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    each = each.select("replicate", "climate_region", i.cast("int").alias("draw_index"), ((i * i * 7919 + i * r * 31 + r * 104729) % F.col("n")).alias("place"))
    return _drawn(each, own)


def multiplicities(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("replicate", "climate_region", "source_site").agg(F.count("*").alias("times"))


def draw_checksums(drawn: DataFrame) -> DataFrame:
    """A digest of each replicate's draws in order: of its regions' digests, so that no list is longer than a region's sites."""
    line = F.concat_ws("\0", "climate_region", "source_site", "bootstrap_site", F.col("draw_index").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("draw_index", line.alias("line"))))
    regions = drawn.groupBy("replicate", "climate_region").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), 256).alias("of_region"), F.count("*").alias("n"))
    both = F.array_sort(F.collect_list(F.struct("climate_region", "of_region")))
    return regions.groupBy("replicate").agg(F.sha2(F.array_join(F.transform(both, lambda x: x["of_region"]), "\n"), 256).alias("sha256"), F.sum("n").alias("n_draws"))


def materialised(drawn: DataFrame, rows: DataFrame) -> DataFrame:
    """rows of the drawn sites under their new names, as often as they were drawn."""
    source = rows.withColumnRenamed("site_id", "source_site").drop("climate_region")
    return drawn.join(source, "source_site").withColumnRenamed("bootstrap_site", "site_id")


def burden(drawn: DataFrame, site_periods: DataFrame) -> DataFrame:
    """Equal-site and pooled shares of each replicate, region and period.

    A site's rows are weighted by the times it was drawn, so rows are never copied, and
    count in the region that they are of.
    """
    m = multiplicities(drawn).drop("climate_region")
    joined = m.join(site_periods.withColumnRenamed("site_id", "source_site"), "source_site")
    t = F.col("times")
    return joined.groupingSets([["replicate", "climate_region", "period"], ["replicate", "period"]], "replicate", "climate_region", "period").agg(
        (F.sum(t * F.col("share")) / F.sum(t)).alias("equal_site_share"), (F.sum(t * F.col("n_elevated")) / F.sum(t * F.col("n_valid"))).alias("row_weighted_share"), F.grouping("climate_region").alias("g")
    ).withColumn("scope", F.when(F.col("g") == 1, "national").otherwise(F.col("climate_region"))).drop("g", "climate_region")


def changes(shares: DataFrame) -> DataFrame:
    """(replicate, scope, quantity, value): later minus early in percentage points."""
    def diff(c: str):
        return 100 * (F.max(F.when(F.col("period") == "later", F.col(c))) - F.max(F.when(F.col("period") == "early", F.col(c))))

    wide = shares.groupBy("replicate", "scope").agg(diff("equal_site_share").alias("equal_site"), diff("row_weighted_share").alias("row_weighted"))
    return wide.unpivot(["replicate", "scope"], ["equal_site", "row_weighted"], "quantity", "value")


def intervals(values: DataFrame, points: DataFrame | None = None, *, lower: float = 0.025, upper: float = 0.975, digits: int = 6) -> DataFrame:
    """Percentile intervals and moments of value by scope and quantity, with the point's rank if points are given."""
    q = F.percentile("value", F.array(F.lit(lower), F.lit(0.5), F.lit(upper)))
    keys = ["scope", "quantity"]
    joined = values if points is None else values.join(points.select(*keys, "point"), keys)
    aggs = [] if points is None else [F.max("point").alias("point"), (100 * F.avg((F.col("value") <= F.col("point")).cast("double"))).alias("point_rank")]
    out = joined.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), q.alias("q"), F.min_by("replicate", F.struct("value", "replicate")).alias("argmin"), *aggs)
    names = ["mean", "sd", "lo", "hi"] + ([] if points is None else ["point", "point_rank"])
    return out.select(
        *keys, "n", *[F.round(n, digits).alias(n) for n in names], *[F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(("lower", "median", "upper"))],
        C.relation_to_zero(F.col("q")[0], F.col("q")[2]).alias("relation"), "argmin",
    )


def first_replicates(values: DataFrame, counts: list[int], digits: int = 6) -> DataFrame:
    """Interval ends from the first replicates alone, for each count."""
    each = values.withColumn("first_n", F.explode(F.array(*[F.lit(n) for n in counts]))).where(F.col("replicate") <= F.col("first_n"))
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy("scope", "quantity", "first_n").agg(q.alias("q")).select("scope", "quantity", "first_n", F.round(F.col("q")[0], digits).alias("lower"), F.round(F.col("q")[1], digits).alias("upper"))


def unfinished(replicates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Replicates without a successful attempt, to be run or run again."""
    return replicates.join(attempts.where("success").select("replicate"), "replicate", "left_anti")
