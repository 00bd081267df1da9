"""Views that present the test tables in the shapes of the real feeds.

Wells come from ``supplier``, monthly production from ``lineitem``, rigs and forecast
requests from ``customer``.  Every formula is a pure projection of one table, so the
views prune columns and push filters like the real feeds would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellkin.params import BASINS
from wellkin.sources.files import with_request_defaults

# The test tables hold dates of 1995-2001, so the date floors move back with them.
BOUND_BASINS = BASINS.override(min_vintage_year=1995)
SPUD_FLOOR = "1994-01-01"
PRODUCTION_FLOOR = "1994-01-01"
LEGACY_FLOOR = "1995-01-01"
TRAINING_YEARS = (1995, 1997)
TEST_YEAR = 1998
ALTERNATE_CUT = 1998
AS_OF_YEAR = 2002


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _well_id(k: str) -> str:
    return (
        f"concat(CASE WHEN {k} % 10 = 9 THEN '42' WHEN {k} % 2 = 0 THEN '05'"
        f" WHEN {k} % 4 = 1 THEN '33' ELSE '25' END, lpad(string({k}), 8, '0'))"
    )


def _spud(k: str) -> str:
    return f"date_add(date'1994-07-01', int(({k} * 37) % 1500))"


def _lat(k: str) -> str:
    return f"IF({k} % 2 = 0, 40D, 47.6D) + (({k} * 7919) % 1000) / 1000D * 0.6D"


def _lon(k: str) -> str:
    return f"IF({k} % 2 = 0, -104.8D, -103.6D) + (({k} * 104729) % 997) / 997D * 0.8D"


def _formation(k: str) -> str:
    return (
        f"CASE WHEN {k} % 2 = 0 THEN IF({k} div 10 % 2 = 0, 'NIOBRARA', 'CODELL')"
        f" ELSE IF({k} div 10 % 2 = 0, 'BAKKEN', 'THREE FORKS') END"
    )


def _operator(nation: str) -> str:
    return f"concat('OP', string({nation} % 6))"


def well_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").selectExpr(*_headers("s_suppkey"))


def _headers(k: str) -> list[str]:
    return [
        f"{_well_id(k)} AS well_api",
        "s_name AS well_name",
        f"IF({k} % 29 <> 28, {_operator('s_nationkey')}, NULL) AS operator_name",
        f"CASE WHEN {k} % 10 = 9 THEN 'TX' WHEN {k} % 2 = 0 THEN 'CO'"
        f" WHEN {k} % 4 = 1 THEN 'ND' ELSE 'MT' END AS state_abbr",
        f"concat('County ', string({k} % 7)) AS county",
        f"{_lat(k)} AS surface_lat",
        f"{_lon(k)} AS surface_lng",
        f"{_spud(k)} AS spud_date",
        f"IF({k} % 19 <> 18, date_add({_spud(k)}, 120), NULL) AS completion_date",
        f"IF({k} % 3 = 2, 'GAS', 'OIL') AS well_type",
        f"IF({k} % 8 = 7, 'Vertical', 'Horizontal') AS drill_type",
        f"IF({k} % 17 <> 16, {_formation(k)}, NULL) AS reservoir",
        f"IF({k} % 23 <> 22, int(8000 + ({k} * 613) % 4000), NULL) AS lateral_length",
        f"8000000 + ({k} * 7561) % 12000000 AS proppant_lbs",
        f"double(300000 + ({k} * 977) % 400000) AS water_gals",
    ]


def drawn_together(wells: DataFrame, share: float = 0.2) -> DataFrame:
    """Dense fields: each bound field is a box from a corner; distances from it shrink to a share."""
    north = "lat > 45"
    return wells.selectExpr(
        *[c for c in wells.columns if c not in ("lat", "lon")],
        f"IF({north}, 47.6D, 40D) + (lat - IF({north}, 47.6D, 40D)) * {share!r}D AS lat",
        f"IF({north}, -103.6D, -104.8D) + (lon - IF({north}, -103.6D, -104.8D)) * {share!r}D AS lon",
    ).select(*wells.columns)


def legacy_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "s_suppkey"
    return load(spark, sf_dir, "supplier").selectExpr(
        *_headers(k),
        f"concat('DOC-', string({k})) AS universal_doc_no",
        f"IF({k} % 2 = 0, 'Denver Basin', 'Williston') AS basin_name",
        f"int(15000 + ({k} * 31) % 6000) AS measured_depth",
        f"int(6000 + ({k} * 17) % 2000) AS true_vertical_depth",
        f"IF({k} % 11 = 10, 'SHUT IN', 'PRODUCING') AS well_status",
        f"IF({k} % 13 <> 12, timestamp(date_sub({_spud(k)}, 60)), NULL) AS permit_date",
    )


def _feed(spark: SparkSession, sf_dir: str, skip_flag: str, quantity: str) -> DataFrame:
    """One feed row per well and month; the well's spud date is a function of its key."""
    k = "l_suppkey"
    lines = load(spark, sf_dir, "lineitem").filter(
        f"l_returnflag <> '{skip_flag}' AND l_shipdate >= {_spud(k)}"
    )
    return (
        lines.selectExpr(k, "trunc(l_shipdate, 'month') AS production_date", f"{quantity} AS q")
        .groupBy(k, "production_date")
        .sum("q")
        .selectExpr(
            f"{_well_id(k)} AS state_well_id",
            "production_date",
            "double(`sum(q)`) AS production_quantity",
        )
    )


def liquids_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir, "R", "CAST(l_extendedprice AS DECIMAL(18, 2))")


def gas_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir, "A", "l_quantity")


def rigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    spud = f"date_add(date'1998-01-01', int({k} % 1500))"
    return load(spark, sf_dir, "customer").selectExpr(
        f"IF({k} % 31 <> 30, concat('R', string({k})), NULL) AS rig_id",
        f"concat('L', string({k} % 400)) AS rig_location_id",
        "c_name AS name",
        f"IF({k} % 13 <> 12, 40D + ({k} % 500) / 500D, NULL) AS latitude",
        f"-104.8D + ({k} % 700) / 700D AS longitude",
        f"{_operator('c_nationkey')} AS operator_name",
        f"concat('Driller ', string({k} % 9)) AS driller",
        f"{_well_id(k)} AS well_api",
        f"IF({k} % 2 = 0, 'CO', 'ND') AS state_abbr",
        f"concat('County ', string({k} % 7)) AS county_name",
        f"IF({k} % 2 = 0, 'Denver Basin', 'Williston') AS basin_name",
        f"timestamp(date_add({spud}, 30)) AS last_reported",
        f"IF({k} % 7 <> 6, timestamp({spud}), NULL) AS spud_date",
        f"timestamp(date_sub({spud}, 45)) AS permit_date",
        f"IF({k} % 5 = 4, 'Vertical', 'Horizontal') AS drill_type",
        f"{_formation(k)} AS reservoir",
        "'feed' AS source",
        f"IF({k} % 3 = 0, 'field', 'office') AS source_type",
        f"IF({k} % 4 = 0, 'Y', 'N') AS pad_reported",
        "'gps' AS coords_source",
    )


def forecast_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned wells, some of them far from every producing well."""
    k = "c_custkey"
    raw = load(spark, sf_dir, "customer").selectExpr(
        f"concat('NEW', string({k})) AS well_id",
        f"IF({k} % 50 = 49, 35D, {_lat(k)}) AS lat",
        f"IF({k} % 50 = 49, -99D, {_lon(k)}) AS lon",
        f"{_formation(k)} AS formation",
        f"double(8000 + ({k} * 431) % 4000) AS lateral_length",
        f"IF({k} % 5 <> 4, double(900 + ({k} * 13) % 1200), NULL) AS proppant_per_ft",
        f"IF({k} % 6 <> 5, double(30 + {k} % 40), NULL) AS fluid_per_ft",
        f"IF({k} % 4 <> 3, {_operator('c_nationkey')}, NULL) AS operator",
        f"IF({k} % 3 <> 2, date_add(date'1997-01-01', int({k} % 1200)), NULL) AS planned_date",
    )
    return with_request_defaults(raw)


def curve_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "label", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding"
    )
