"""Candidate pairs and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellkin.functions import series
from wellkin.functions.matching import (
    candidate,
    ratio,
    same_formation,
    same_operator,
    target,
    year_gap,
)
from wellkin.operators import percentiles
from wellkin.operators.radius import prefixed, within_radius
from wellkin.params import BASINS, BasinSet

SPACING_DEFAULTS = {
    "wells_within_1mi_at_start": 0,
    "wells_within_3mi_at_start": 0,
    "distance_to_nearest_at_start": 999.0,
    "distance_to_second_nearest_at_start": 999.0,
}

_PAIR_COLUMNS = [
    "well_id", "basin_name", "lat", "lon", "first_prod_date", "lateral_length",
    "proppant_per_ft", "fluid_per_ft", "operator_name", "formation",
]


def match(
    early: DataFrame,
    basins: BasinSet = BASINS,
    max_zero: int = 2,
    on: tuple[str, ...] = ("basin_name",),
    radius: str | float | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Pairs of wells of a basin where the candidate started no later than the target,
    lies within the basin's radius and has a similar lateral.

    ``known`` has further columns of the candidates, by ``well_id``, null where it lacks a well."""
    tolerance = basins.value("lateral_tolerance")
    usable = early.filter(
        basins.api_match(F.col("well_id"))
        & (F.year("first_prod_date") >= basins.value("min_vintage_year"))
    )
    candidate_ok = series.count_where(F.col("oil"), lambda v: v == 0) <= max_zero
    targets = prefixed(
        usable.select(
            *_PAIR_COLUMNS,
            (F.col("lateral_length") * (1 - tolerance)).alias("shortest"),
            (F.col("lateral_length") * (1 + tolerance)).alias("longest"),
        ),
        "target_",
        on,
    )
    candidates = usable.filter(candidate_ok).select(*_PAIR_COLUMNS)
    if known is not None:
        candidates = candidates.join(known, "well_id", "left")
    candidates = prefixed(candidates, "candidate_", on)
    rule = (
        "target_id <> candidate_id AND candidate_first_prod_date <= target_first_prod_date"
        " AND candidate_lateral_length BETWEEN target_shortest AND target_longest"
    )
    reach = basins.sql("max_distance_miles") if radius is None else radius
    return within_radius(targets, candidates, reach, on, rule).drop(
        "target_shortest", "target_longest"
    )


def measure(pairs: DataFrame) -> DataFrame:
    """The measures of a pair, candidate relative to target."""
    t, c = target, candidate
    return pairs.withColumns(
        {
            "length_ratio": ratio(c("lateral_length"), t("lateral_length")),
            "delta_length": c("lateral_length") - t("lateral_length"),
            "formation_match": same_formation(c("formation"), t("formation")),
            "same_operator": same_operator(c("operator_name"), t("operator_name")),
            "vintage_gap_years": year_gap(t("first_prod_date"), c("first_prod_date")),
            "ppf_ratio": ratio(c("proppant_per_ft"), t("proppant_per_ft")),
            "fpf_ratio": ratio(c("fluid_per_ft"), t("fluid_per_ft")),
        }
    )


def build(
    early: DataFrame, basins: BasinSet = BASINS, spacing: DataFrame | None = None
) -> DataFrame:
    """The candidate table: pairs, measures and the candidate's spacing at its start.

    The spacing joins the wells, not their pairs, which grow with the square of the wells."""
    known = None if spacing is None else spacing.select("well_id", *SPACING_DEFAULTS)
    pairs = measure(match(early, basins, known=known))
    columns = [
        "basin_name",
        "distance_mi",
        "length_ratio",
        "delta_length",
        "formation_match",
        "same_operator",
        "vintage_gap_years",
        "ppf_ratio",
        "fpf_ratio",
        "target_first_prod_date",
        "candidate_first_prod_date",
        "target_operator_name",
        "candidate_operator_name",
        "target_formation",
        "candidate_formation",
    ]
    if known is None:
        plain = pairs.select("target_id", "candidate_id", *columns)
        return plain.withColumns({k: F.lit(v) for k, v in SPACING_DEFAULTS.items()})
    own = [F.col(f"candidate_{c}").alias(c) for c in SPACING_DEFAULTS]
    return pairs.select("candidate_id", "target_id", *columns, *own).fillna(SPACING_DEFAULTS)


def top(pairs: DataFrame, early: DataFrame, n: int = 100) -> DataFrame:
    """The n nearest stored candidates of every target, with candidate volumes."""
    order = Window.partitionBy("target_id").orderBy(
        "distance_mi", F.abs(1 - F.col("length_ratio")), "candidate_id"
    )
    volumes = early.select(
        F.col("well_id").alias("candidate_id"),
        *[F.col(c).alias(f"candidate_{c}") for c in ("avg_oil", "avg_gas", "cum_oil", "cum_gas")],
    )
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .join(volumes, "candidate_id")
    )


def of_well(pairs: DataFrame, early: DataFrame, well_id: str, n: int = 100) -> DataFrame:
    """J14 for one target; the filter reaches the stored pairs."""
    return top(pairs.filter(F.col("target_id") == well_id), early, n).orderBy("rank")


def _percent(flag: str) -> Column:
    return F.avg(F.when(F.col(flag), 1.0).otherwise(0.0)) * 100


def stats(pairs: DataFrame) -> DataFrame:
    """Pool statistics per basin, the median by `percentiles.exact`.

    Wells of either side are counted after a grouping of their own: two distinct counts beside
    the averages would write every pair three times.
    """

    def different(side: str) -> DataFrame:
        wells = pairs.filter(F.col(f"{side}_id").isNotNull()).select("basin_name", f"{side}_id").distinct()
        return wells.groupBy("basin_name").agg(F.count("*").alias(f"unique_{side}s"))

    plain = pairs.groupBy("basin_name").agg(
        F.count("*").alias("total_pairs"),
        F.avg("distance_mi").alias("avg_distance_mi"),
        _percent("formation_match").alias("pct_formation_match"),
        _percent("same_operator").alias("pct_same_operator"),
        F.avg("vintage_gap_years").alias("avg_vintage_gap"),
        F.min("distance_mi").alias("min_distance_mi"),
        F.max("distance_mi").alias("max_distance_mi"),
        F.avg("wells_within_1mi_at_start").alias("avg_wells_1mi"),
        F.avg("wells_within_3mi_at_start").alias("avg_wells_3mi"),
        F.avg("distance_to_nearest_at_start").alias("avg_nearest_mi"),
        F.avg("distance_to_second_nearest_at_start").alias("avg_second_nearest_mi"),
    )
    median = percentiles.exact(pairs, ["basin_name"], "distance_mi", {"median_distance_mi": 0.5})
    counted = plain.join(different("target"), "basin_name").join(different("candidate"), "basin_name")
    return counted.join(median, "basin_name")


def per_target(pairs: DataFrame) -> DataFrame:
    """How many candidates the targets of a basin have.

    The median sees whole numbers, of which P pairs allow at most sqrt(2 P) different ones.
    """
    counts = pairs.groupBy("basin_name", "target_id").agg(F.count("*").alias("n"))
    return counts.groupBy("basin_name").agg(
        F.avg("n").alias("avg_candidates_per_target"),
        F.min("n").alias("min_candidates"),
        F.max("n").alias("max_candidates"),
        F.percentile("n", F.lit(0.5)).alias("median_candidates"),
    )


def first_targets(targets: DataFrame, limit: int | None) -> DataFrame:
    """Distinct target ids, optionally only the first ones by id (trial runs)."""
    distinct = targets.select("target_id").distinct()
    return distinct.orderBy("target_id").limit(limit) if limit else distinct


#: Wells of a side table that every task may hold; with a curve they take some 300 bytes each.
FEW_WELLS = 500_000


def beside(wells: DataFrame) -> DataFrame:
    """The side table of a join with pairs, held by every task if its wells are proven few.

    Pairs grow with the square of the wells, so they should not be exchanged for them."""
    few = wells.limit(FEW_WELLS + 1).count() <= FEW_WELLS
    return F.broadcast(wells) if few else wells


def _with_side(
    pairs: DataFrame,
    early: DataFrame,
    side: str,
    columns: list[str],
    optional: DataFrame | None = None,
    more: list[str] | None = None,
) -> DataFrame:
    """Attach columns of one side's well to each pair, and those that an ``optional`` table has
    of it (J10).  The tables of wells are joined first, so each side is one join of the pairs."""
    wells = early.select("well_id", *columns)
    if optional is not None:
        wells = wells.join(optional.select("well_id", *more), "well_id", "left")
    named = [F.col(c).alias(f"{side}_{'id' if c == 'well_id' else c}") for c in wells.columns]
    return pairs.join(beside(wells.select(*named)), f"{side}_id")


def with_optional(pairs: DataFrame, table: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """The same, keeping pairs whose well is not in the side table."""
    wells = table.select(
        F.col("well_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns]
    )
    return pairs.join(beside(wells), f"{side}_id", "left")


_PEAK_COLUMNS = ["peak_oil", "peak_gas", "peak_oil_month", "oil_decline_rate"]


def training_pairs(
    pairs: DataFrame,
    early: DataFrame,
    peaks: DataFrame,
    years: tuple[int, int] = (2016, 2023),
    limit: int | None = None,
) -> DataFrame:
    """Same-formation pairs of targets that started in the training years."""
    started = early.filter(F.year("first_prod_date").between(*years)).select(
        F.col("well_id").alias("target_id")
    )
    wanted = first_targets(pairs.join(started, "target_id", "left_semi"), limit)
    chosen = pairs.filter("formation_match").join(
        wanted if limit else beside(started), "target_id", "left_semi"
    )
    columns = ["oil", "lateral_length", "proppant_per_ft"]
    chosen = _with_side(chosen, early, "target", columns, peaks, _PEAK_COLUMNS)
    return _with_side(chosen, early, "candidate", columns, peaks, _PEAK_COLUMNS)


def training_pairs_alt(
    pairs: DataFrame,
    early: DataFrame,
    embeddings: DataFrame | None = None,
    before: int = 2020,
    max_distance: float = 15.0,
    limit: int | None = None,
) -> DataFrame:
    """Pairs up to a distance, targets before a year, embeddings on both sides."""
    old = early.filter(F.year("first_prod_date") < before).select(
        F.col("well_id").alias("target_id")
    )
    wanted = first_targets(pairs.join(old, "target_id", "left_semi"), limit)
    chosen = pairs.filter(F.col("distance_mi") <= max_distance).join(
        wanted if limit else beside(old), "target_id", "left_semi"
    )
    columns = [
        "oil", "lat", "lon", "lateral_length", "proppant_per_ft", "fluid_per_ft",
        "cum_oil", "cum_gas", "avg_oil",
    ]
    for side in ("target", "candidate"):
        more = [] if embeddings is None else ["oil_embedding"]
        chosen = _with_side(chosen, early, side, columns, embeddings, more)
        start = F.col(f"{side}_first_prod_date")
        chosen = chosen.withColumns(
            {f"{side}_vintage_year": F.year(start), f"{side}_vintage_month": F.month(start)}
        )
    return chosen
