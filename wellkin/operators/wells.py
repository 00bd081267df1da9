"""Header cleaning and labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellkin.functions.matching import in_range
from wellkin.params import BASINS, BasinSet, prefix_match

# Ingest date floors.
SPUD_FLOOR = "2014-01-01"
LEGACY_DATE_FLOOR = "2000-01-01"


def _date(value: str) -> Column:
    return F.lit(value).cast("date")


def filter_label(
    raw: DataFrame, basins: BasinSet = BASINS, min_spud: str = SPUD_FLOOR
) -> DataFrame:
    """Keep wells inside a basin spudded since the floor, and label them."""
    place = ("state_abbr", "surface_lat", "surface_lng")
    return (
        raw.filter((F.col("spud_date") >= _date(min_spud)) & basins.in_fence(*place))
        .withColumns(
            {
                "basin": basins.fence_label(*place, "code"),
                "basin_name": basins.fence_label(*place, "name"),
            }
        )
    )


def standardise(labelled: DataFrame) -> DataFrame:
    """The stored well table's names and types."""
    return labelled.select(
        F.col("well_api").alias("well_id"),
        "well_name",
        F.col("operator_name").alias("operator"),
        F.col("state_abbr").alias("state"),
        "county",
        "basin",
        "basin_name",
        F.lit(None).cast("string").alias("sub_basin"),
        F.col("surface_lat").cast("double").alias("lat"),
        F.col("surface_lng").cast("double").alias("lon"),
        F.col("spud_date").cast("date").alias("spud_date"),
        F.col("completion_date").cast("date").alias("completion_date"),
        F.lit(None).cast("date").alias("first_prod_date"),
        "well_type",
        "drill_type",
        F.col("reservoir").alias("formation"),
        F.col("lateral_length").cast("int").alias("lateral_length"),
        F.col("proppant_lbs").cast("bigint").alias("proppant_lbs"),
        F.col("water_gals").cast("double").alias("fluid_gals"),
        F.current_timestamp().alias("created_at"),
    )


def absent_or_since(name: str, floor: str) -> Column:
    """Null-tolerant date floor."""
    return F.col(name).isNull() | (F.col(name) >= F.lit(floor).cast("timestamp"))


def per_foot(amount: str, length: str = "lateral_length") -> Column:
    """Amount per foot of lateral; null when the lateral is missing or not positive."""
    return F.when(F.col(length) > 0, F.col(amount) / F.col(length))


def clean_legacy(raw: DataFrame, floor: str = LEGACY_DATE_FLOOR) -> DataFrame:
    """Legacy wide headers; the completion date stands in for first production."""
    return (
        raw.filter(
            absent_or_since("completion_date", floor)
            & absent_or_since("spud_date", floor)
            & absent_or_since("permit_date", floor)
            & F.col("well_api").isNotNull()
            & F.col("surface_lat").isNotNull()
            & F.col("surface_lng").isNotNull()
            & F.col("completion_date").isNotNull()
        )
        .select(
            F.col("well_api").alias("well_id"),
            "universal_doc_no",
            F.col("surface_lat").cast("double").alias("lat"),
            F.col("surface_lng").cast("double").alias("lon"),
            F.col("operator_name").alias("operator"),
            F.col("reservoir").alias("formation"),
            "well_name",
            F.col("state_abbr").alias("state"),
            "county",
            F.col("basin_name").alias("basin"),
            F.col("completion_date").cast("timestamp").alias("first_prod_date"),
            F.col("lateral_length").cast("int").alias("lateral_length"),
            F.col("proppant_lbs").cast("bigint").alias("proppant_lbs"),
            F.col("water_gals").cast("double").alias("fluid_gals"),
            F.col("measured_depth").cast("int").alias("measured_depth"),
            F.col("true_vertical_depth").cast("int").alias("tvd"),
            "drill_type",
            "well_type",
            "well_status",
            F.col("spud_date").cast("timestamp").alias("spud_date"),
            F.col("permit_date").cast("timestamp").alias("permit_date"),
        )
        .withColumns(
            {"proppant_per_ft": per_foot("proppant_lbs"), "fluid_per_ft": per_foot("fluid_gals")}
        )
    )


def clean_rigs(raw: DataFrame, floor: str = LEGACY_DATE_FLOOR) -> DataFrame:
    """Rigs with an id and a place, not older than the floor; all count as active."""
    return (
        raw.filter(
            absent_or_since("spud_date", floor)
            & absent_or_since("permit_date", floor)
            & F.col("rig_id").isNotNull()
            & F.col("latitude").isNotNull()
            & F.col("longitude").isNotNull()
        )
        .select(
            "rig_id",
            "rig_location_id",
            F.col("name").alias("rig_name"),
            F.col("latitude").cast("double").alias("lat"),
            F.col("longitude").cast("double").alias("lon"),
            F.col("operator_name").alias("operator"),
            "driller",
            F.col("well_api").alias("well_id"),
            F.col("state_abbr").alias("state"),
            F.col("county_name").alias("county"),
            F.col("basin_name").alias("basin"),
            F.col("last_reported").cast("timestamp").alias("last_reported"),
            F.col("spud_date").cast("timestamp").alias("spud_date"),
            F.col("permit_date").cast("timestamp").alias("permit_date"),
            "drill_type",
            "reservoir",
            "source",
            "source_type",
            "pad_reported",
            "coords_source",
            F.current_timestamp().alias("created_at"),
            F.lit("active").alias("status"),
        )
    )


def completion_flags(
    df: DataFrame,
    basins: BasinSet = BASINS,
    lateral: str = "lateral_length",
    proppant: str = "proppant_per_ft",
    fluid: str = "fluid_per_ft",
) -> DataFrame:
    """Whether lateral, proppant and fluid lie in their basin's usual range."""
    return df.withColumns(
        {
            "lateral_length_valid": in_range(F.col(lateral), basins, "lateral_min", "lateral_max"),
            "proppant_valid": in_range(F.col(proppant), basins, "proppant_min", "proppant_max"),
            "fluid_valid": in_range(F.col(fluid), basins, "fluid_min", "fluid_max"),
        }
    )


def by_basin(wells: DataFrame) -> DataFrame:
    """Wells per basin."""
    return wells.groupBy("basin", "basin_name").agg(F.count("*").alias("wells"))


def legacy_denver(
    wells: DataFrame,
    min_spud: str = "2010-01-01",
    state: str = "CO",
    orientation: str = "Horizontal",
    basin: str = "Denver Basin",
) -> DataFrame:
    """P10: the older exact filter for horizontal wells of one basin."""
    return wells.filter(
        (F.col("state") == state)
        & (F.col("drill_type") == orientation)
        & (F.col("spud_date") >= _date(min_spud))
        & (F.col("basin") == basin)
    )


def well_count(wells: DataFrame) -> DataFrame:
    return wells.agg(F.count_distinct("well_id").alias("wells"))


def horizontal_subset(
    wells: DataFrame,
    min_spud: str = "2010-01-01",
    state: str = "CO",
    basin_pattern: str = "%DJ%",
    prefixes: tuple[str, ...] = ("05",),
) -> DataFrame:
    """Producing horizontal wells of one basin, by name pattern or id prefix."""
    return wells.filter(
        (F.col("state") == state)
        & (F.col("drill_type") == "Horizontal")
        & (F.col("spud_date") >= _date(min_spud))
        & (F.col("basin").ilike(basin_pattern) | prefix_match(F.col("well_id"), prefixes))
        & (F.col("lateral_length") > 0)
        & F.col("first_prod_date").isNotNull()
    )


def publish_view(df: DataFrame, name: str) -> None:
    """Publish a frame under a name for SQL users of the session."""
    df.createOrReplaceTempView(name)
