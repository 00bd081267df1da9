"""Nine-month curves per well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellkin.functions import series
from wellkin.params import BASINS, MONTHS, BasinSet

MAX_ZERO_MONTHS = 2


def history(production: DataFrame, months: int = MONTHS) -> DataFrame:
    """Per well: history measures and its first ``months`` values, in two hash aggregates.

    The first collapses rows that share a month (the later date wins), the second spreads
    the months into slots.  Neither collects rows of a group.  Production that comes
    straight from alignment is already partitioned by well, so neither shuffles it again.
    """
    oil_missing = F.coalesce(F.col("oil_bbls"), F.lit(0.0)) == 0
    by_month = production.groupBy("well_id", "prod_month").agg(
        F.max_by("oil_bbls", "prod_date").alias("oil"),
        F.max_by("gas_mcf", "prod_date").alias("gas"),
        F.count("*").alias("rows"),
        F.count_if(oil_missing).alias("zeros"),
        F.min("prod_date").alias("first"),
    )
    in_window = F.col("prod_month").between(0, months - 1)

    def slot(name: str, month: int) -> Column:
        return F.max(F.when(F.col("prod_month") == month, F.col(name))).alias(f"_{name}{month}")

    def dense(name: str) -> Column:
        return series.per_slot(
            months, lambda m: F.coalesce(F.col(f"_{name}{m}"), F.lit(0.0))
        ).alias(f"{name}_curve")

    return (
        by_month.groupBy("well_id")
        .agg(
            F.min("first").alias("first_prod_date"),
            F.count("*").alias("months_available"),
            F.sum("zeros").alias("zero_rows"),
            F.coalesce(F.sum(F.when(in_window, F.col("rows"))), F.lit(0)).alias("window_rows"),
            *[slot("oil", m) for m in range(months)],
            *[slot("gas", m) for m in range(months)],
        )
        .select(
            "well_id",
            "first_prod_date",
            "months_available",
            "zero_rows",
            "window_rows",
            dense("oil"),
            dense("gas"),
        )
    )


def eligible(
    production: DataFrame,
    wells: DataFrame,
    basins: BasinSet = BASINS,
    months: int = MONTHS,
    max_zero: int | None = MAX_ZERO_MONTHS,
) -> DataFrame:
    """Wells with enough months, few dry rows in their whole history, a lateral and a
    recent enough start.  ``max_zero=None`` switches the whole-history rule off."""
    past = history(production, months).filter(F.col("months_available") >= months)
    if max_zero is not None:
        past = past.filter(F.col("zero_rows") <= max_zero)
    headers = wells.filter(F.col("lateral_length") > 0).select(
        "well_id",
        "basin_name",
        F.col("operator").alias("operator_name"),
        "formation",
        "lat",
        "lon",
        F.col("lateral_length").cast("double").alias("lateral_length"),
        F.col("proppant_lbs").cast("double").alias("proppant_used"),
        F.col("fluid_gals").cast("double").alias("water_used"),
    )
    vintage = F.make_date(basins.value("min_vintage_year"), F.lit(1), F.lit(1))
    return past.join(headers, "well_id").filter(F.col("first_prod_date") >= vintage)


def newest(df: DataFrame, limit: int) -> DataFrame:
    """The newest wells first, for trial runs."""
    return df.orderBy(F.col("first_prod_date").desc(), "well_id").limit(limit)


def early_rates(
    production: DataFrame,
    wells: DataFrame,
    basins: BasinSet = BASINS,
    months: int = MONTHS,
    max_zero: int = MAX_ZERO_MONTHS,
    max_history_zero: int | None = MAX_ZERO_MONTHS,
) -> DataFrame:
    """The early-curve table, one row per well."""
    complete = eligible(production, wells, basins, months, max_history_zero).filter(
        F.col("window_rows") >= months
    )
    zero = series.count_where(F.col("oil_curve"), lambda v: v == 0)
    oil, gas, lateral = F.col("oil_curve"), F.col("gas_curve"), F.col("lateral_length")

    def per_ft(name: str) -> Column:
        return F.coalesce(F.col(name) / lateral, F.lit(0.0))

    def per_kft(curve: Column) -> Column:
        return F.transform(curve, lambda v: v * 1000.0 / lateral)

    return (
        complete.withColumn("zero_months_count", zero)
        .filter(F.col("zero_months_count") <= max_zero)
        .select(
            "well_id",
            "basin_name",
            "operator_name",
            "formation",
            "lat",
            "lon",
            "first_prod_date",
            "lateral_length",
            "proppant_used",
            "water_used",
            per_ft("proppant_used").alias("proppant_per_ft"),
            per_ft("water_used").alias("fluid_per_ft"),
            oil.alias("oil"),
            gas.alias("gas"),
            per_kft(oil).alias("oil_norm"),
            per_kft(gas).alias("gas_norm"),
            series.log1p(oil).alias("oil_log"),
            series.log1p(gas).alias("gas_log"),
            "zero_months_count",
            series.mean(oil).alias("avg_oil"),
            series.mean(gas).alias("avg_gas"),
            series.total(oil).alias("cum_oil"),
            series.total(gas).alias("cum_gas"),
        )
    )


def long_form(early: DataFrame) -> DataFrame:
    """One row per well and month 1-9."""
    zipped = F.arrays_zip("oil", "gas", "oil_norm", "gas_norm", "oil_log", "gas_log")
    return early.select("well_id", F.posexplode(zipped).alias("pos", "v")).select(
        "well_id", (F.col("pos") + 1).alias("month"), "v.*"
    )


def stats(early: DataFrame) -> DataFrame:
    """A16."""
    return early.agg(
        F.count("*").alias("total_wells"),
        F.count_distinct("operator_name").alias("unique_operators"),
        F.count_distinct("formation").alias("unique_formations"),
        F.avg("lateral_length").alias("avg_lateral_length"),
        F.avg("cum_oil").alias("avg_cum_oil"),
        F.avg("cum_gas").alias("avg_cum_gas"),
        F.min("first_prod_date").alias("earliest_prod"),
        F.max("first_prod_date").alias("latest_prod"),
    )


def monthly_series(production: DataFrame, n: int = MONTHS) -> DataFrame:
    """Oil and gas in month order, for wells with exactly ``n`` rows before month ``n``.

    Only rows of the first ``n`` months reach the group, and groups of another size are
    dropped on the count; a group holds at most the dates of ``n`` calendar months.
    """
    rows = F.sort_array(
        F.collect_list(
            F.struct(
                "prod_month",
                "prod_date",
                F.coalesce("oil_bbls", F.lit(0.0)).alias("oil"),
                F.coalesce("gas_mcf", F.lit(0.0)).alias("gas"),
            )
        )
    )
    return (
        production.filter(F.col("prod_month") < n)
        .groupBy("well_id")
        .agg(F.count("*").alias("_n"), rows.alias("_rows"))
        .filter(F.col("_n") == n)
        .select("well_id", F.col("_rows.oil").alias("oil"), F.col("_rows.gas").alias("gas"))
    )
