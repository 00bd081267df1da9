"""Well spacing as it was when a well started."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellkin.operators.candidates import SPACING_DEFAULTS
from wellkin.operators.radius import CELL, prefixed, within_radius
from wellkin.params import BASINS, BasinSet


def around(pairs: DataFrame, inner: float, on: tuple[str, ...]) -> DataFrame:
    """Of each target: ``inner`` and ``outer`` (pairs within the inner radius and at all) and
    ``nearest`` (its two smallest distances, ascending), from one reading of the pairs.

    The pairs lie partitioned by cell, and a target lies in one cell: counts and ranks are
    taken where the join left the rows, and at most two rows of a target and part of a cell
    go through the exchange that puts the parts together.
    """
    own = Window.partitionBy(*on, *CELL, "target_id")
    placed = pairs.select(
        "target_id",
        "distance_mi",
        F.row_number().over(own.orderBy("distance_mi")).alias("place"),
        F.count_if(F.col("distance_mi") <= inner).over(own).alias("inner"),
        F.count("*").over(own).alias("outer"),
    )
    first = F.col("place") == 1
    return (
        placed.filter(F.col("place") <= 2)
        .groupBy("target_id")
        .agg(
            F.sum(F.when(first, F.col("inner"))).alias("inner"),
            F.sum(F.when(first, F.col("outer"))).alias("outer"),
            F.slice(F.sort_array(F.collect_list("distance_mi")), 1, 2).alias("nearest"),
        )
    )


def at_start(
    early: DataFrame, basins: BasinSet = BASINS, radii: tuple[float, float] = (1.0, 3.0)
) -> DataFrame:
    """Per well: earlier-or-equal wells within each radius and the two nearest distances.

    The counts need only the outer radius, so they use a grid of that size.  A well with two
    neighbours inside the outer radius has its nearest two there; only the others search the
    basin's full distance.  They are few: of the wells inside a disc half as wide as the outer
    radius, in date order, only the first two can lack two earlier neighbours, so their number
    follows the area covered.  What the outer radius shows is kept by a checkpoint, one row per
    well, so its join is made once.
    """
    on = ("basin_name",)
    wells = early.select("basin_name", "well_id", "lat", "lon", "first_prod_date")
    subject = prefixed(wells, "target_", on)
    other = prefixed(wells, "candidate_", on)
    existed = "target_id <> candidate_id AND candidate_first_prod_date <= target_first_prod_date"
    inner, outer = radii

    def seen(radius: str | float, skip: DataFrame | None = None) -> DataFrame:
        pairs = within_radius(subject, other, radius, on, existed, skip, cells=True)
        return around(pairs, inner, on)

    close = seen(outer).checkpoint()
    settled = close.filter(F.col("outer") >= 2).select("target_id")
    far = seen(basins.sql("max_distance_miles"), settled).select("target_id", F.col("nearest").alias("far"))
    return (
        wells.selectExpr("basin_name", "well_id", "well_id AS target_id")
        .join(close, "target_id", "left")
        .join(far, "target_id", "left")
        .selectExpr(
            "basin_name",
            "well_id",
            "`inner` AS wells_within_1mi_at_start",
            "`outer` AS wells_within_3mi_at_start",
            "coalesce(get(far, 0), get(nearest, 0)) AS distance_to_nearest_at_start",
            "coalesce(get(far, 1), get(nearest, 1)) AS distance_to_second_nearest_at_start",
        )
        .fillna(SPACING_DEFAULTS)
    )
