"""Monthly production shaping.

Shuffles: the feeds are first collapsed to one row per (well, date) with map-side
partial aggregation, so a well that holds a large share of the raw feed shrinks to at
most one row per calendar date before anything is grouped by well.  From there one
exchange on ``well_id`` carries the history gate, first date, month index, peak month
and alignment: all of them are windows over the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Production date floor, history gate, peak window.
PRODUCTION_FLOOR = "2014-01-01"
MIN_MONTHS = 9
PEAK_WINDOW = 7


def _per_well():
    return Window.partitionBy("well_id")


def _feed(feed: DataFrame, floor: str, oil: Column, gas: Column) -> DataFrame:
    return feed.filter(F.col("production_date") >= F.lit(floor).cast("date")).select(
        F.col("state_well_id").alias("well_id"),
        F.col("production_date").cast("date").alias("prod_date"),
        oil.cast("double").alias("oil_bbls"),
        gas.cast("double").alias("gas_mcf"),
    )


def union_feeds(liquids: DataFrame, gas: DataFrame, floor: str = PRODUCTION_FLOOR) -> DataFrame:
    """A1, A2: both feeds in one four-column shape."""
    volume, nothing = F.col("production_quantity"), F.lit(None)
    return _feed(liquids, floor, volume, nothing).unionByName(_feed(gas, floor, nothing, volume))


def of_wells(production: DataFrame, wells: DataFrame) -> DataFrame:
    """A3: production of known wells only.

    A semi join, so repeated ids in the well list do not multiply rows.  The list grows
    with the data: whether it is broadcast is left to its size at run time, and a well that
    holds much of an unbroadcast feed is split by the adaptive skew join, which may cut the
    kept side of a semi join.
    """
    return production.join(wells.select("well_id"), "well_id", "left_semi")


def monthly_max(production: DataFrame) -> DataFrame:
    """A4: one row per well and date with the largest oil and the largest gas."""
    return production.groupBy("well_id", "prod_date").agg(
        F.max("oil_bbls").alias("oil_bbls"), F.max("gas_mcf").alias("gas_mcf")
    )


def history_gate(monthly: DataFrame, min_months: int = MIN_MONTHS) -> DataFrame:
    """A5: wells with enough distinct dates.  Input: one row per (well, date)."""
    return (
        monthly.withColumn("_dates", F.count("prod_date").over(_per_well()))
        .filter(F.col("_dates") >= min_months)
        .drop("_dates")
    )


def month_index(monthly: DataFrame) -> DataFrame:
    """Each row's whole months since the well's first date."""
    return monthly.withColumn(
        "true_first_prod_date", F.min("prod_date").over(_per_well())
    ).withColumn(
        "month_index",
        F.floor(F.months_between("prod_date", "true_first_prod_date")).cast("bigint"),
    )


def _peak_candidate(window: int | Column) -> Column:
    """Sort key of a possible peak row: larger oil first, then the earlier date."""
    eligible = (F.col("month_index") < window) & (F.col("oil_bbls") > 0)
    return F.when(eligible, F.struct("oil_bbls", (-F.unix_date("prod_date")).alias("earlier")))


def peak_month(indexed: DataFrame, window: int = PEAK_WINDOW) -> DataFrame:
    """The peak month and its oil, one row per well that has one."""
    key = _peak_candidate(window)
    return (
        indexed.groupBy("well_id")
        .agg(F.max_by("month_index", key).alias("peak_month"), F.max(key).alias("_peak"))
        .filter(F.col("peak_month").isNotNull())
        .select("well_id", "peak_month", F.col("_peak.oil_bbls").alias("peak_oil"))
    )


def align(indexed: DataFrame, window: int | Column = PEAK_WINDOW) -> DataFrame:
    """Rows from the peak on, renumbered from 0; wells without a peak drop out."""
    peak = F.max_by("month_index", _peak_candidate(window)).over(_per_well())
    return (
        indexed.withColumn("peak_month", peak)
        .filter(F.col("month_index") >= F.col("peak_month"))
        .withColumn("prod_month", (F.col("month_index") - F.col("peak_month")).cast("bigint"))
    )


def with_basin(aligned: DataFrame, wells: DataFrame) -> DataFrame:
    """A10: the stored production table."""
    return aligned.join(wells.select("well_id", "basin", "basin_name"), "well_id", "left").select(
        "well_id",
        "prod_date",
        "prod_month",
        "oil_bbls",
        "gas_mcf",
        "basin",
        "basin_name",
        F.lit(None).cast("double").alias("water_bbls"),
        F.current_timestamp().alias("created_at"),
    )


def first_dates(production: DataFrame) -> DataFrame:
    """Earliest production date per well."""
    return production.groupBy("well_id").agg(F.min("prod_date").alias("first_prod_date"))


def peak_distribution(peaks: DataFrame) -> DataFrame:
    """Wells per peak month."""
    return peaks.groupBy("peak_month").agg(F.count("*").alias("wells"))


def distribution(production: DataFrame) -> DataFrame:
    """Wells and records per basin, counted through per-well partial sums."""
    per_well = production.groupBy("basin", "basin_name", "well_id").agg(
        F.count("*").alias("records")
    )
    return per_well.groupBy("basin", "basin_name").agg(
        F.count("*").alias("wells"), F.sum("records").alias("records")
    )


def build(
    liquids: DataFrame,
    gas: DataFrame,
    wells: DataFrame,
    floor: str = PRODUCTION_FLOOR,
    window: int | Column = PEAK_WINDOW,
    min_months: int = MIN_MONTHS,
) -> DataFrame:
    """A1-A10 in one plan."""
    monthly = monthly_max(of_wells(union_feeds(liquids, gas, floor), wells))
    return with_basin(align(month_index(history_gate(monthly, min_months)), window), wells)
