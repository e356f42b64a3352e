"""Comparison of a variant's results with the primary ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.functions import columns as C


def sensitivity(primary: DataFrame, variant: DataFrame, *, material: float = 0.5) -> DataFrame:
    """Components of a variant beside the primary ones, with the direction of the change."""
    both = primary.select("scope", F.col("temperature_component").alias("p"), F.col("response_component").alias("q")).join(
        variant.select("scope", F.col("temperature_component").alias("v"), F.col("response_component").alias("w")), "scope"
    )
    p, v = F.col("p"), F.col("v")
    direction = (
        F.when(F.signum(p) * F.signum(v) < 0, "reversed").when(F.abs(v) > F.abs(p) + 1e-9, "strengthened").when(F.abs(v) < F.abs(p) - 1e-9, "weakened").otherwise("unchanged")
    )
    return both.select(
        "scope", p.alias("primary"), v.alias("variant"), F.round(v - p, 6).alias("difference"), direction.alias("direction"),
        ((direction == "reversed") | (F.abs(v - p) >= material)).alias("is_major"), C.component_relation(p, F.col("q")).alias("primary_relation"), C.component_relation(v, F.col("w")).alias("variant_relation"),
    )


def directions(continuous: DataFrame, threshold: DataFrame) -> DataFrame:
    """Whether the mean outcome and the share over the threshold moved the same way."""
    both = continuous.join(threshold, "scope")
    return both.select("scope", "continuous_change", "threshold_change", C.direction_agreement(F.col("continuous_change"), F.col("threshold_change")).alias("agreement"))
