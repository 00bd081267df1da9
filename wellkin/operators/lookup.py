"""Analog lookups for given targets (J6-J8): nearest k under per-use rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellkin.functions.matching import candidate, ratio, same_operator, target, year_gap
from wellkin.operators.candidates import beside
from wellkin.operators.radius import nearest_within, prefixed
from wellkin.params import BASINS, BasinSet

# Radius, tolerance and size of the lookups.
NEW_WELL_RADIUS, NEW_WELL_TOLERANCE = 15.0, 0.2
EVALUATION_RADIUS = 20.0
LOOKUP_SIZE = 500

_COLUMNS = [
    "well_id", "basin_name", "formation", "lat", "lon", "first_prod_date", "lateral_length",
    "proppant_per_ft", "fluid_per_ft", "operator_name",
]


def _candidates(early: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return prefixed(early.select(*_COLUMNS), "candidate_", keep)


def analogs(
    targets: DataFrame,
    early: DataFrame,
    basins: BasinSet = BASINS,
    k: int | None = None,
    radius: str | float | None = None,
    tolerance: float | None = None,
) -> DataFrame:
    """The k nearest same-formation wells that started strictly before the target.

    ``k`` is the basin's ``top_k`` unless given.  Formation is a join key, so it splits the cells
    as well.  Targets without formation or lateral find nothing.
    """
    on = ("basin_name", "formation")
    reach = basins.sql("max_distance_miles") if radius is None else radius
    slack = basins.value("lateral_tolerance") if tolerance is None else F.lit(tolerance)
    lateral = F.col("lateral_length")
    wanted = targets.filter(F.col("formation").isNotNull() & (lateral > 0)).select(
        "well_id",
        *on,
        "lat",
        "lon",
        "first_prod_date",
        "lateral_length",
        (lateral * (1 - slack)).alias("shortest"),
        (lateral * (1 + slack)).alias("longest"),
    )
    known = early.filter(F.year("first_prod_date") >= basins.value("min_vintage_year"))
    rule = (
        "candidate_first_prod_date < target_first_prod_date"
        " AND candidate_lateral_length BETWEEN target_shortest AND target_longest"
    )
    most = max(b.top_k for b in basins) if k is None else k
    return (
        nearest_within(
            prefixed(wanted, "target_", on),
            _candidates(known, on),
            reach,
            most,
            on,
            rule,
        )
        .filter(F.col("analog_rank") <= (basins.value("top_k") if k is None else F.lit(k)))
        .withColumn(
            "length_ratio", ratio(F.col("candidate_lateral_length"), F.col("target_lateral_length"))
        )
        .drop("target_shortest", "target_longest")
    )


def new_well(
    requests: DataFrame,
    early: DataFrame,
    radius: float = NEW_WELL_RADIUS,
    k: int = LOOKUP_SIZE,
    tolerance: float = NEW_WELL_TOLERANCE,
    as_of_year: Column | int | None = None,
) -> DataFrame:
    """Nearest wells of any basin and formation for a planned well.

    Ratios are target over candidate.  A request without a date sees every well.
    ``as_of_year`` (default: the current year) dates the vintage.
    """
    year = F.year(F.current_date()) if as_of_year is None else F.lit(as_of_year)
    t, c = target, candidate
    wanted = prefixed(
        requests.select(
            "well_id", "lat", "lon", "formation", "lateral_length", "proppant_per_ft",
            "fluid_per_ft", "operator", "planned_date",
        ),
        "target_",
    )
    rule = (
        "(target_planned_date IS NULL OR candidate_first_prod_date <= target_planned_date)"
        f" AND candidate_lateral_length BETWEEN target_lateral_length * {1 - tolerance!r}D"
        f" AND target_lateral_length * {1 + tolerance!r}D"
    )
    found = nearest_within(wanted, _candidates(early, ()), radius, k, (), rule)
    return found.withColumns(
        {
            "length_ratio": ratio(t("lateral_length"), c("lateral_length")),
            "delta_length": t("lateral_length") - c("lateral_length"),
            "formation_match": F.when(
                F.upper(c("formation")) == F.upper(t("formation")), 1
            ).otherwise(0),
            "ppf_ratio": ratio(t("proppant_per_ft"), c("proppant_per_ft")),
            "fpf_ratio": ratio(t("fluid_per_ft"), c("fluid_per_ft")),
            "vintage_years": year - F.year(c("first_prod_date")),
        }
    )


def evaluation(
    targets: DataFrame,
    early: DataFrame,
    radius: float = EVALUATION_RADIUS,
    k: int = LOOKUP_SIZE,
) -> DataFrame:
    """Nearest earlier wells of exactly the target's formation, any lateral."""
    on = ("basin_name", "formation")
    t, c = target, candidate
    found = nearest_within(
        prefixed(targets.select(*_COLUMNS), "target_", on),
        _candidates(early, on),
        radius,
        k,
        on,
        "candidate_first_prod_date < target_first_prod_date",
    )
    return found.withColumns(
        {
            "length_ratio": ratio(c("lateral_length"), t("lateral_length")),
            "delta_length": c("lateral_length") - t("lateral_length"),
            "formation_match": F.lit(1),
            "same_operator": same_operator(c("operator_name"), t("operator_name")).cast("int"),
            "vintage_gap_years": year_gap(t("first_prod_date"), c("first_prod_date")),
            "ppf_ratio": ratio(c("proppant_per_ft"), t("proppant_per_ft")),
            "fpf_ratio": ratio(c("fluid_per_ft"), t("fluid_per_ft")),
        }
    )


def with_curves(
    found: DataFrame, early: DataFrame, columns: tuple[str, ...] = ("oil",)
) -> DataFrame:
    """Attach candidate curves after the top-k cut, so arrays never ride the radius join."""
    curves = early.select(
        F.col("well_id").alias("candidate_id"),
        *[F.col(c).alias(f"candidate_{c}") for c in columns],
    )
    return found.join(beside(curves), "candidate_id")
