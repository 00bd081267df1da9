"""The code that Spark generates for pairs stays small enough to be compiled."""

import re

from wellkin.operators import candidates
from wellkin.params import BASINS

#: Bytes of a method beyond which the JVM only interprets it.
COMPILED = 8000


def test_pair_code_is_compiled(spark):
    early = spark.createDataFrame(
        [],
        "well_id string, basin_name string, lat double, lon double, first_prod_date date,"
        " lateral_length double, proppant_per_ft double, fluid_per_ft double,"
        " operator_name string, formation string, oil array<double>",
    )
    spacing = spark.createDataFrame(
        [],
        "well_id string, wells_within_1mi_at_start long, wells_within_3mi_at_start long,"
        " distance_to_nearest_at_start double, distance_to_second_nearest_at_start double",
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = candidates.build(early, BASINS, spacing)._jdf.queryExecution().executedPlan()
        text = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < COMPILED
