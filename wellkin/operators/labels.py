"""Training labels and the train/validation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellkin.functions import series
from wellkin.operators.baseline import warp
from wellkin.operators.candidates import beside
from wellkin.params import early_weights, revenue_weights

# Share of a target's pairs that is excellent, good, fair.
GRADE_SHARES = (0.10, 0.30, 0.60)
GOOD_ERROR = 0.2

# A pair on a threshold counts as inside it whatever the rounding of the interpolation.
_TIE = 1e-9


def pair_score(pairs: DataFrame) -> DataFrame:
    """weighted error relative to the target's mean, score exp(-error), good-pair flag."""
    target, candidate = F.col("target_oil"), F.col("candidate_oil")
    gap = series.weighted_mae(target, candidate, early_weights())
    error = F.coalesce(gap / (series.mean(target) + 1), F.lit(1.0))
    return (
        pairs.withColumn("production_error", error)
        .withColumn("analog_score", F.exp(-F.col("production_error")))
        .withColumn("is_good_analog", (F.col("production_error") < GOOD_ERROR).cast("int"))
    )


def revenue_error(
    pairs: DataFrame,
    kappa_length: Column | float = 0.6,
    kappa_proppant: Column | float = 0.2,
    length_direction: str = "candidate",
) -> DataFrame:
    """Discounted-revenue error of the warped candidate curve.

    ``length_direction`` says which side is the numerator of the length ratio; labels put
    the candidate there.  The proppant ratio is target over candidate plus one.
    """
    ratio = F.col("length_ratio")
    if length_direction == "target":
        ratio = 1 / ratio
    warped = warp(
        F.col("candidate_oil"),
        ratio,
        F.col("target_proppant_per_ft") / (F.col("candidate_proppant_per_ft") + 1),
        kappa_length,
        kappa_proppant,
    )
    return pairs.withColumn("_warped", warped).withColumn(
        "revenue_error",
        series.weighted_mae(F.col("target_oil"), F.col("_warped"), revenue_weights()),
    ).drop("_warped")


def graded(
    pairs: DataFrame,
    kappa_length: Column | float = 0.6,
    kappa_proppant: Column | float = 0.2,
    length_direction: str = "candidate",
) -> DataFrame:
    """label 3/2/1/0 by where the error falls among the target's pairs.

    The three thresholds are an aggregate per target joined back, not a window, so no task
    sorts or buffers the pairs themselves.  The aggregate's state is one number per candidate
    of the target, that is per well within its radius.  The thresholds, one row per target, are kept by
    a checkpoint and travel to the pairs.
    """
    scored = revenue_error(pairs, kappa_length, kappa_proppant, length_direction)
    found = scored.groupBy("target_id").agg(
        F.percentile("revenue_error", F.array(*[F.lit(s) for s in GRADE_SHARES])).alias("_cuts")
    )
    cuts = beside(found.checkpoint())
    error = F.col("revenue_error")
    grade = (
        F.when(error <= F.col("_cuts")[0] + _TIE, 3)
        .when(error <= F.col("_cuts")[1] + _TIE, 2)
        .when(error <= F.col("_cuts")[2] + _TIE, 1)
        .otherwise(0)
    )
    return scored.join(cuts, "target_id").withColumn("label", grade).drop("_cuts")


def split(pairs: DataFrame, share: float = 0.8) -> DataFrame:
    """the first share of the targets by id trains, the rest validates."""
    marked = _positions(pairs.select("target_id").distinct()).select(
        "target_id",
        F.when(F.col("_position") <= F.floor(F.col("_total") * share), "train")
        .otherwise("valid")
        .alias("split"),
    )
    return pairs.join(marked, "target_id")


def _positions(targets: DataFrame) -> DataFrame:
    """1-based position of each distinct id in id order, and their number.

    Ids are dealt to tasks by ranges, wherever their order differs, and numbered there; a range
    starts after the ids of the ranges before it.  The ranges are kept by a checkpoint, so that
    their counts and the numbers speak of the same ones.  Only the counts, one row per range,
    pass through the unpartitioned window.
    """
    ranged = targets.repartitionByRange("target_id").sortWithinPartitions("target_id")
    place = F.monotonically_increasing_id()  # the range in the upper bits, the row in the lower 33
    numbered = ranged.select("target_id", place.alias("_place")).checkpoint().select(
        "target_id",
        F.shiftright("_place", 33).alias("_range"),
        F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"),
    )
    in_order = Window.orderBy("_range")
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        "_range",
        (F.sum("_size").over(in_order) - F.col("_size")).alias("_offset"),
        F.sum("_size")
        .over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("_total"),
    )
    return numbered.join(offsets, "_range").select(
        "target_id", (F.col("_in") + F.col("_offset") + 1).alias("_position"), "_total"
    )
