"""Data-quality checks and summaries.

Production is reduced to one row per well before it meets the wells, so no check joins the
raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wellkin.operators.production import MIN_MONTHS, PEAK_WINDOW, first_dates
from wellkin.params import BASINS, BasinSet


# What the bounds checks call a basin and its wells; check names and result
# texts below are fixed values too.
_BOUNDS_NAMES = {"dj_basin": ("DJ Basin", "DJ"), "bakken": ("Bakken", "Bakken")}


def _verdict(test: str, bad: Column, failure: Column) -> list[Column]:
    return [
        F.lit(test).alias("test_name"),
        F.when(bad == 0, "PASS").otherwise(failure).alias("result"),
        bad.cast("bigint").alias("n_bad"),
    ]


def _fail(bad: Column, what: str) -> Column:
    return F.concat(F.lit("FAIL - "), bad.cast("string"), F.lit(f" {what}"))


def basin_consistency(wells: DataFrame, production: DataFrame) -> DataFrame:
    """Q1: production rows labelled with another basin than their well."""
    labels = production.groupBy("well_id", "basin", "basin_name").agg(
        F.count("*").alias("rows")
    )
    w = wells.select("well_id", F.col("basin").alias("_b"), F.col("basin_name").alias("_n"))
    bad = (
        labels.join(w, "well_id")
        .filter((F.col("_b") != F.col("basin")) | (F.col("_n") != F.col("basin_name")))
        .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    )
    n = F.col("n")
    return bad.select(*_verdict("Basin Consistency Check", n, _fail(n, "mismatched basins")))


def date_mismatches(wells: DataFrame, production: DataFrame) -> DataFrame:
    """Q2: wells whose stored first production date is not their earliest row."""
    actual = first_dates(production).withColumnRenamed("first_prod_date", "actual_first_prod")
    return (
        wells.select("well_id", "first_prod_date")
        .join(actual, "well_id")
        .filter(F.col("first_prod_date") != F.col("actual_first_prod"))
    )


def first_date_accuracy(wells: DataFrame, production: DataFrame) -> DataFrame:
    bad = date_mismatches(wells, production).agg(F.count("*").alias("n"))
    n = F.col("n")
    return bad.select(
        *_verdict("First Prod Date Accuracy", n, _fail(n, "wells have incorrect first_prod_date"))
    )


def peak_alignment(production: DataFrame, window: int = PEAK_WINDOW) -> DataFrame:
    """Q3: wells whose first aligned month lies in the peak window (a count, not a verdict)."""
    aligned = (
        production.groupBy("well_id")
        .agg(F.min("prod_month").alias("first"))
        .filter(F.col("first").between(0, window - 1))
        .agg(F.count("*").alias("n"))
    )
    text = F.concat(
        F.lit(f"Peak months 0-{window - 1}: "), F.col("n").cast("string"), F.lit(" wells")
    )
    return aligned.select(
        F.lit("Peak Month Alignment").alias("test_name"),
        text.alias("result"),
        F.lit(0).cast("bigint").alias("n_bad"),
    )


def geographic_bounds(wells: DataFrame, basins: BasinSet = BASINS) -> DataFrame:
    """Q4: wells outside the bounds or states of their own basin; one scan for all basins."""
    inside = basins.in_own_fence("basin_name", "state", "lat", "lon")
    counts = wells.agg(
        *[
            F.count_if((F.col("basin_name") == b.name) & ~inside).alias(b.name) for b in basins
        ]
    )
    rows = [
        counts.select(
            *_verdict(
                f"{_BOUNDS_NAMES.get(b.name, (b.title, b.title))[0]} Geographic Bounds",
                F.col(b.name),
                _fail(
                    F.col(b.name),
                    f"{_BOUNDS_NAMES.get(b.name, (b.title, b.title))[1]} wells outside bounds",
                ),
            )
        )
        for b in basins
    ]
    return reduce(DataFrame.unionByName, rows)


def history_length(production: DataFrame, min_months: int = MIN_MONTHS) -> DataFrame:
    """Q5: the shortest history after alignment, against the gate applied before it."""
    months = production.groupBy("well_id").agg(F.count_distinct("prod_date").alias("months"))
    least = months.agg(
        F.min("months").alias("least"),
        F.count_if(F.col("months") < min_months).alias("n"),
    )
    ok = F.col("least") >= min_months
    result = F.concat(
        F.lit(f"All wells have {min_months}+ months: "),
        F.when(ok, "PASS").otherwise(
            F.concat(F.lit("FAIL - Min months: "), F.col("least").cast("string"))
        ),
    )
    return least.select(
        F.lit("Production History Check").alias("test_name"),
        result.alias("result"),
        F.col("n").cast("bigint").alias("n_bad"),
    )


def validate(
    wells: DataFrame, production: DataFrame, basins: BasinSet = BASINS
) -> DataFrame:
    """Q1-Q5 as one table (test_name, result, n_bad)."""
    checks = [
        basin_consistency(wells, production),
        first_date_accuracy(wells, production),
        peak_alignment(production),
        geographic_bounds(wells, basins),
        history_length(production),
    ]
    return reduce(DataFrame.unionByName, checks)


def _per_well(production: DataFrame) -> DataFrame:
    return production.groupBy("well_id").agg(F.count("*").alias("records"))


def _production_of(wells: DataFrame, production: DataFrame) -> DataFrame:
    """One row per distinct well with its number of production rows, null if none."""
    distinct = wells.select("well_id", "basin", "basin_name").distinct()
    return distinct.join(_per_well(production), "well_id", "left")


def volume_summary(wells: DataFrame, production: DataFrame) -> DataFrame:
    """Q6: wells, wells with production, records and whole records per well, by basin."""
    total = F.count("*")
    records = F.coalesce(F.sum("records"), F.lit(0))
    return (
        _production_of(wells, production)
        .groupBy("basin", "basin_name")
        .agg(
            total.alias("wells_total"),
            F.count("records").alias("wells_with_production"),
            records.alias("production_records"),
            F.floor(records / total).alias("avg_records_per_well"),
        )
    )


def well_date_ranges(wells: DataFrame) -> DataFrame:
    """Q7."""
    return (
        wells.filter(F.col("first_prod_date").isNotNull())
        .groupBy("basin_name")
        .agg(
            F.min("spud_date").alias("earliest_spud"),
            F.max("spud_date").alias("latest_spud"),
            F.min("first_prod_date").alias("earliest_first_prod"),
            F.max("first_prod_date").alias("latest_first_prod"),
        )
    )


def production_date_ranges(production: DataFrame) -> DataFrame:
    """Q7: months are collapsed first, so the distinct count sees one row per month."""
    months = production.groupBy("basin_name", F.trunc("prod_date", "month").alias("month")).agg(
        F.min("prod_date").alias("first"), F.max("prod_date").alias("last")
    )
    return months.groupBy("basin_name").agg(
        F.min("first").alias("earliest_prod_data"),
        F.max("last").alias("latest_prod_data"),
        F.count("month").alias("months_of_data"),
    )


def completeness(wells: DataFrame) -> DataFrame:
    """Q8: filled completion columns and their averages, by basin."""
    return wells.groupBy("basin_name").agg(
        F.count("*").alias("total_wells"),
        F.count("lateral_length").alias("wells_with_lateral_length"),
        F.count("proppant_lbs").alias("wells_with_proppant"),
        F.count("fluid_gals").alias("wells_with_fluid"),
        F.round(F.avg("lateral_length"), 0).alias("avg_lateral_length"),
        F.round(F.avg("proppant_lbs"), 0).alias("avg_proppant_lbs"),
    )


def first_date_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q9: filled and missing first production dates before and after an update."""

    def count(wells: DataFrame, status: str) -> DataFrame:
        filled = F.count("first_prod_date")
        return wells.agg(
            F.count("*").alias("total_wells"),
            filled.alias("wells_with_first_prod_date"),
            (F.count("*") - filled).alias("wells_missing_first_prod_date"),
        ).select(F.lit(status).alias("status"), "*")

    return count(before, "before").unionByName(count(after, "after"))


def coverage(wells: DataFrame, production: DataFrame) -> DataFrame:
    """Q10: share of wells with production, by basin."""
    total, having = F.count("*"), F.count("records")
    return (
        _production_of(wells, production)
        .groupBy("basin", "basin_name")
        .agg(
            total.alias("total_wells"),
            having.alias("wells_with_production"),
            (total - having).alias("wells_without_production"),
            F.round(100.0 * having / total, 2).alias("production_percentage"),
        )
    )


def zero_month_impact(curves: DataFrame, max_zero: int = 2) -> DataFrame:
    """Q11: wells that a zero-month rule removes, by basin."""
    removed = F.count_if(F.col("zero_months_count") > max_zero)
    return curves.groupBy("basin_name").agg(
        F.count("*").alias("total_wells"),
        removed.alias("wells_to_remove"),
        F.round(100.0 * removed / F.count("*"), 1).alias("percent_removed"),
    )


def without_production(wells: DataFrame, production: DataFrame) -> DataFrame:
    """Wells with no production rows, by basin."""
    return (
        wells.join(production.select("well_id").distinct(), "well_id", "left_anti")
        .groupBy("basin", "basin_name")
        .agg(F.count("*").alias("wells_without_production"))
    )


def reconcile(wells: DataFrame, production: DataFrame) -> DataFrame:
    """Distinct wells on either side, from the full outer join of the two."""
    left = wells.select(F.col("well_id").alias("w")).distinct()
    right = production.select(F.col("well_id").alias("p")).distinct()
    return left.join(right, F.col("w") == F.col("p"), "full").agg(
        F.count("w").alias("wells_in_model_wells"),
        F.count("p").alias("wells_in_model_prod"),
        (F.count("w") - F.count("p")).alias("wells_without_production"),
    )
