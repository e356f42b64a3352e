"""Whether some direction of several columns separates a binary outcome, by cutting planes.

With an effect for each site, a direction separates a region if, in every site, no one lies
below a zero along it. So the constraints are the differences between ones and zeros of one
site. The driver keeps few of them and finds the direction that all of these allow, as the
point of least norm of their hull; one pass over the rows finds, for each site, the pair that
a direction breaks most. A hull that holds the origin is a certificate that nothing separates
strictly; then the differences that make up the origin must be zero along any direction that
still separates, and the search goes on in what they leave.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.operators.regression import region_factors, site_sums
from paneloom.operators.tables import kept

#: Broken constraints that a region adds in a round, rounds, and what counts as zero for columns of variance one.
ADDED, ROUNDS, ZERO = 64, 200, 1e-8


def least_norm(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The point of least norm of the hull of points: itself, which points it is made of, and their weights."""
    sizes = np.einsum("ij,ij->i", points, points)
    some, weights = [int(np.argmin(sizes))], np.ones(1)
    z = points[some[0]]
    for _ in range(20 * len(points) + 100):
        along = points @ z
        j = int(np.argmin(along))
        if z @ z - along[j] <= 1e-13 * max(sizes.max(), 1e-300) or j in some:
            break
        some, weights = [*some, j], np.append(weights, 0.0)
        while True:
            own = points[some]
            flat = np.linalg.lstsq(own @ own.T + sizes.max(), np.ones(len(some)), rcond=None)[0]
            flat /= flat.sum()
            if (flat > 1e-13).all():
                weights = flat
                break
            out = flat <= 1e-13
            step = min(1.0, (weights[out] / np.maximum(weights[out] - flat[out], 1e-300)).min())
            weights = (1 - step) * weights + step * flat
            good = weights > 1e-13
            if good.all():
                good[np.argmin(weights)] = False
            some, weights = [i for i, g in zip(some, good, strict=True) if g], weights[good] / weights[good].sum()
        z = weights @ points[some]
    return z, np.array(some), weights


@dataclass
class Search:
    """A region's search: its cuts, the directions still open (columns of space), and what it has found."""

    cuts: np.ndarray
    space: np.ndarray
    strict: bool = True
    status: str | None = None
    direction: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def next(self) -> bool:
        """Sets the next direction to try; false if there is none."""
        while self.space.shape[1]:
            open_ = self.cuts @ self.space
            open_ = open_[np.linalg.norm(open_, axis=1) > ZERO] if len(open_) else open_
            if not len(open_):
                self.direction = self.space[:, 0]
                return True
            z, some, _ = least_norm(open_)
            if np.linalg.norm(z) > ZERO:
                self.direction = self.space @ (z / np.linalg.norm(z))
                return True
            self.strict = False
            # What makes up the origin stays at zero along any direction that is left.
            _, sizes, directions = np.linalg.svd(open_[some])
            rank = int((sizes > ZERO * max(1.0, sizes[0])).sum())
            self.space = self.space @ directions[rank:].T
        self.status = "none"
        return False

    def learn(self, cuts: np.ndarray, margins: np.ndarray) -> None:
        """Takes the worst pairs along the direction."""
        if (np.linalg.norm(cuts, axis=1) <= ZERO).any():
            self.strict = False  # a one and a zero at the same place
        if margins.min(initial=np.inf) > ZERO and self.strict:
            self.status = "complete"
        elif margins.min(initial=np.inf) >= -ZERO:
            if self.strict:  # pairs on the border: no strict separation along this direction, perhaps along another
                self.cuts = np.vstack([self.cuts, cuts[margins <= ZERO]])
                if np.linalg.norm(least_norm(self.cuts)[0]) <= ZERO:
                    self.status = "quasi"
            else:
                self.status = "quasi"
        else:
            self.cuts = np.vstack([self.cuts, cuts[margins < -ZERO]])


def separation(rows: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """For each region, sites of one outcome and of both, the rank of the columns, and whether a direction of them separates.

    complete: in every site that varies the ones lie beyond the zeros along some direction;
    quasi: they lie beyond or level; none; undecided after ROUNDS. Sites of one outcome have
    no finite effect and are counted. Columns count as far as they vary within sites. The
    driver gets a factor of each region's products and at most ADDED pairs of a region a round.
    """
    one = F.col(y) == 1
    rows = kept(rows.select("climate_region", "site_id", *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)], one.alias("one")), "separation-rows")
    names = [f"x{i}" for i in range(len(xs))]
    sites = rows.groupBy("climate_region", "site_id").agg(F.count_if("one").alias("n1"), F.count("*").alias("n"))
    varies = (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
    counts = sites.groupBy("climate_region").agg(F.count_if(F.col("n1") == 0).alias("all_zero_sites"), F.count_if(F.col("n1") == F.col("n")).alias("all_one_sites"), F.count_if(varies).alias("varying_sites"))
    table = kept(counts, "separation-sites")
    rows = rows.join(kept(sites.where(varies).select("site_id"), "varying-sites"), "site_id", "left_semi")
    sums = kept(site_sums(rows.withColumn("_none", F.lit(0.0)), names, "_none"), "site-sums")
    factors = {r: f * n**0.5 for r, (f, _, n) in region_factors(sums, len(xs)).items()}
    searches = {r: Search(np.empty((0, f.shape[1])), np.eye(f.shape[1])) for r, f in factors.items()}
    for _ in range(ROUNDS):
        going = {r: factors[r] @ s.direction for r, s in searches.items() if s.status is None and s.next()}
        if not going:
            break
        place = None
        for region, b in going.items():
            value = sum((F.col(n) * float(c) for n, c in zip(names, b, strict=True)), F.lit(0.0))
            here = F.col("climate_region") == region
            place = F.when(here, value) if place is None else place.when(here, value)
        along = rows.withColumn("s", place).where("s is not null")
        ends = along.groupBy("climate_region", "site_id").agg(
            F.min_by(F.array(*names), F.when(F.col("one"), F.col("s"))).alias("a"), F.max_by(F.array(*names), F.when(~F.col("one"), F.col("s"))).alias("b"), (F.min(F.when(F.col("one"), F.col("s"))) - F.max(F.when(~F.col("one"), F.col("s")))).alias("margin"),
        )
        worst = ends.withColumn("k", F.row_number().over(Window.partitionBy("climate_region").orderBy("margin", "site_id"))).where(F.col("k") <= ADDED).collect()
        for region in going:
            own = [r for r in worst if r["climate_region"] == region]
            cuts = (np.array([r["a"] for r in own]) - np.array([r["b"] for r in own])) @ factors[region]
            searches[region].learn(cuts, np.array([r["margin"] for r in own]))
    found = [(r, factors[r].shape[1], s.status or "undecided") for r, s in searches.items()]
    status = rows.sparkSession.createDataFrame(found, "climate_region string, matrix_rank int, found string")
    return table.join(status, "climate_region", "left").select("climate_region", "all_zero_sites", "all_one_sites", "varying_sites", F.coalesce("matrix_rank", F.lit(0)).alias("matrix_rank"), F.coalesce("found", F.lit("no site varies")).alias("separation"))
