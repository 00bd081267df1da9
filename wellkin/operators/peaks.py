"""Peak features of a curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellkin.functions import series
from wellkin.operators import percentiles

_FLUIDS = ("oil", "gas")


def usable(early: DataFrame) -> DataFrame:
    """wells with both curves, a lateral and a proppant load."""
    return early.dropna(subset=["oil", "gas", "lateral_length", "proppant_per_ft"])


def _per_kft(peak: Column) -> Column:
    lateral = F.col("lateral_length")
    return F.when(lateral > 0, peak / (lateral / 1000)).otherwise(0.0)


def _decline(peak: Column, last: Column) -> Column:
    rate = F.when(peak > 0, (peak - last) / (peak + 1)).otherwise(0.0)
    return series.clamp(rate, 0.0, 1.0)


def features(early: DataFrame) -> DataFrame:
    """largest value, its first 1-based month, peak per length and proppant, decline."""
    wells = usable(early).withColumns({f"peak_{f}": F.array_max(f) for f in _FLUIDS})
    load = F.col("proppant_per_ft")
    return wells.select(
        "well_id",
        "basin_name",
        "peak_oil",
        "peak_gas",
        *[
            F.array_position(f, F.col(f"peak_{f}")).cast("int").alias(f"peak_{f}_month")
            for f in _FLUIDS
        ],
        *[_per_kft(F.col(f"peak_{f}")).alias(f"peak_{f}_per_kft") for f in _FLUIDS],
        F.when(load >= 0, F.col("peak_oil") / (load + 1)).otherwise(0.0).alias("peak_oil_per_ppf"),
        *[
            _decline(F.col(f"peak_{f}"), F.element_at(f, -1)).alias(f"{f}_decline_rate")
            for f in _FLUIDS
        ],
    )


SUMMARY_COLUMNS = (
    "peak_oil", "peak_gas", "peak_oil_per_kft", "peak_gas_per_kft",
    "oil_decline_rate", "gas_decline_rate",
)


def summary(peaks: DataFrame) -> DataFrame:
    """one row per measure with mean, median, min, max and sample deviation."""
    measures = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("measure"), F.col(c).alias("value"))
                for c in SUMMARY_COLUMNS
            ]
        )
    )
    long = peaks.select(measures.alias("m")).select("m.measure", "m.value")
    plain = long.groupBy("measure").agg(
        F.count("value").alias("wells"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("std"),
    )
    return plain.join(percentiles.exact(long, ["measure"], "value", {"median": 0.5}), "measure")


def by_basin(peaks: DataFrame) -> DataFrame:
    """wells per basin and the share that peak in months 1-3."""

    def early(fluid: str) -> Column:
        return F.avg(F.when(F.col(f"peak_{fluid}_month") <= 3, 100.0).otherwise(0.0))

    return peaks.groupBy("basin_name").agg(
        F.count("*").alias("wells"),
        F.count_if(F.col("peak_oil_month") <= 3).alias("early_oil_peaks"),
        F.count_if(F.col("peak_gas_month") <= 3).alias("early_gas_peaks"),
        early("oil").alias("early_oil_pct"),
        early("gas").alias("early_gas_pct"),
    )


def month_histogram(peaks: DataFrame) -> DataFrame:
    """wells per fluid and peak month."""
    months = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("fluid"), F.col(f"peak_{f}_month").alias("month"))
                for f in _FLUIDS
            ]
        )
    )
    return (
        peaks.select(months.alias("m"))
        .groupBy(F.col("m.fluid").alias("fluid"), F.col("m.month").alias("month"))
        .agg(F.count("*").alias("wells"))
    )
