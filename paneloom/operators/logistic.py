"""Logistic regression with site effects by reweighted least squares, and its counterfactual means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators import regression as R
from paneloom.operators import replicates as N
from paneloom.operators.tables import kept


def expit(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def varying_sites(rows: DataFrame, y: str) -> DataFrame:
    """Rows of sites whose outcome is not always the same: others have no finite effect. A site of several regions is one in each."""
    sites = rows.groupBy("climate_region", "site_id").agg(F.min(y).alias("lo"), F.max(y).alias("hi")).where("lo < hi").select("climate_region", "site_id")
    return rows.join(sites, ["climate_region", "site_id"], "left_semi")


def fit(rows: DataFrame, xs: Sequence[str], y: str, *, rounds: int = 25, tolerance: float = 1e-8, limit: float = 30.0) -> DataFrame:
    """Fits like those of regression.fit, of the log odds that y is 1.

    The rows are written once, a site's together, so rounds neither make them anew nor sum
    a site in many tasks. Each round is one pass over the rows: weights and working responses from the last
    fit, then weighted least squares. Effects beyond limit mean that the outcome is
    separated, which is an error, as is a fit that has not settled after all rounds.
    """
    rows = rows.select("climate_region", "site_id", *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias(y))
    rows = kept(rows.repartitionByRange("site_id").sortWithinPartitions("site_id"), "logit-rows")
    fits = None
    for _ in range(rounds):
        eta, at = F.lit(0.0), rows
        if fits is not None:
            at = rows.join(fits.select("climate_region", "site_id", "alpha", "beta"), ["climate_region", "site_id"])
            eta = F.col("alpha")
            for i, x in enumerate(xs):
                eta = eta + F.col("beta")[i] * F.col(x)
        p = expit(eta)
        w = F.greatest(p * (1 - p), F.lit(1e-12))
        new = kept(R.fit(at.withColumns({"_w": w, "_z": eta + (F.col(y) - p) / w}), xs, "_z", weight="_w", apart=True), "logit")
        largest = new.agg(F.max(F.greatest(F.abs("alpha"), F.array_max(F.transform("beta", lambda b: F.abs(b)))))).first()[0]
        if largest is not None and largest > limit:
            raise ValueError(f"separated outcome: an effect of {largest:.3g}")
        if fits is not None:
            old = fits.select("climate_region", "site_id", F.col("alpha").alias("a0"), F.col("beta").alias("b0"))
            step = F.greatest(F.abs(F.col("alpha") - F.col("a0")), F.array_max(F.zip_with("beta", "b0", lambda b, o: F.abs(b - o))))
            if (new.join(old, ["climate_region", "site_id"]).agg(F.max(step)).first()[0] or 0.0) < tolerance:
                return new
        fits = new
    raise ValueError(f"no convergence in {rounds} rounds")


def site_means(rows: DataFrame, fits: DataFrame, design: R.Design, r0: float, r1: float) -> DataFrame:
    """A, B, C and D of each site as probabilities.

    The link is not linear, so each temperature meets each day. A site's distinct
    temperatures and days are two lists of its one row, and their pairs a matrix within a
    task. A site that lacks a period has nulls there.
    """
    temps = rows.groupBy("climate_region", "site_id", "period", F.array(*[F.col(t).cast("double") for t in design.ts]).alias("t")).agg(F.count("*").cast("double").alias("n"))
    sites = temps.groupBy("climate_region", "site_id").agg(F.collect_list(F.struct("period", "n", "t")).alias("c"))
    if design.ss:
        days = rows.select("site_id", "day_of_year", F.array(*[F.col(s).cast("double") for s in design.ss]).alias("s")).dropDuplicates(["site_id", "day_of_year"])
        sites = sites.join(days.groupBy("site_id").agg(F.collect_list("s").alias("days")), "site_id")
    else:
        sites = sites.withColumn("days", F.array(F.array().cast("array<double>")))
    joined = sites.join(fits.select(*R.site_keys(fits), "alpha", "beta"), R.site_keys(fits)).select("climate_region", "site_id", "alpha", "beta", "c.period", "c.n", "c.t", "days")
    skipped = len(design.extra)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                alpha, beta, period, n, t, days = (batch.column(k)[i].as_py() for k in range(2, 8))
                own = np.array(period, object)
                b = np.delete(np.array(beta), range(1, 1 + skipped))
                with np.errstate(invalid="ignore"):
                    found.append(N.probabilities(alpha, b, np.array(t), np.array(n), [own == "early", own == "later"], np.array(days), r0, r1))
            columns = {c: pa.array([None if np.isnan(f[k]) else f[k] for f in found], pa.float64()) for k, c in enumerate("ABCD")}
            # probabilities gives early and later under r0, then under r1.
            yield pa.record_batch([batch.column(0), batch.column(1), *columns.values()], names=["climate_region", "site_id", *columns])

    return joined.mapInArrow(evaluate, "climate_region string, site_id string, A double, B double, C double, D double")
