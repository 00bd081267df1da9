"""Unlearned forecasts: curve warp, nearest-k median, distance-weighted mean (M1-M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellkin.functions import series
from wellkin.params import MONTHS

# Bounds of each warp factor.
WARP_MIN, WARP_MAX = 0.7, 1.3

# Analogs nearer than this weigh alike, so a distance of zero has a finite weight.
MIN_WEIGHT_DISTANCE = 0.1

NO_CANDIDATES = "No candidates found"


def warp_factor(ratio: Column, kappa: Column | float) -> Column:
    """ratio^kappa held within bounds; 1 where the ratio is unknown."""
    power = F.pow(ratio, kappa if isinstance(kappa, Column) else F.lit(kappa))
    return F.when(ratio.isNull(), 1.0).otherwise(series.clamp(power, WARP_MIN, WARP_MAX))


def warp(
    curve: Column,
    length_ratio: Column,
    proppant_ratio: Column,
    kappa_length: Column | float = 0.6,
    kappa_proppant: Column | float = 0.2,
) -> Column:
    """M3: scale a curve for a different lateral length and proppant load."""
    factor = warp_factor(length_ratio, kappa_length) * warp_factor(proppant_ratio, kappa_proppant)
    return series.scale(curve, factor)


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of two positive numbers, null otherwise."""
    return F.when((numerator > 0) & (denominator > 0), numerator / denominator)


def slots(curve: str, build, months: int = MONTHS) -> Column:
    """One aggregate per month, as an array: no explode of the curves."""
    return series.per_slot(months, lambda m: build(F.col(curve)[m]))


def median(analogs: DataFrame, curve: str = "candidate_oil") -> DataFrame:
    """M1: element-wise median of each target's analog curves.

    The groups hold at most k analogs, so the exact median is cheap.
    """
    return analogs.groupBy("target_id").agg(
        slots(curve, F.median).alias("p50_oil"),
        F.count("*").alias("n_analogs"),
        F.avg("distance_mi").alias("avg_distance_mi"),
        F.lit(100.0).alias("formation_match_pct"),
    )


def idw(
    analogs: DataFrame, power: Column | float = 2.0, curve: str = "candidate_oil"
) -> DataFrame:
    """M4: mean of the curves weighted by distance^-power."""
    distance = F.greatest(F.col("distance_mi"), F.lit(MIN_WEIGHT_DISTANCE))
    weighted = analogs.withColumn(
        "_w", 1 / F.pow(distance, power if isinstance(power, Column) else F.lit(power))
    )
    return weighted.groupBy("target_id").agg(
        slots(curve, lambda v: F.sum(v * F.col("_w")) / F.sum("_w")).alias("p50_oil"),
        F.count("*").alias("n_analogs"),
        F.avg("distance_mi").alias("avg_distance_mi"),
    )


def with_errors(
    targets: DataFrame, forecasts: DataFrame, reason: str = NO_CANDIDATES
) -> DataFrame:
    """One row per target; those without a forecast carry the reason."""
    ids = targets.withColumnRenamed("well_id", "target_id")
    return ids.join(forecasts, "target_id", "left").withColumns(
        {
            "error": F.when(F.col("n_analogs").isNull(), reason),
            "n_analogs": F.coalesce("n_analogs", F.lit(0)),
        }
    ).withColumnRenamed("target_id", "well_id")
