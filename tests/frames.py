"""Small hand-made frames."""

from __future__ import annotations

import datetime as dt

EARLY = (
    "well_id string, basin_name string, operator_name string, formation string, lat double, "
    "lon double, first_prod_date date, lateral_length double, proppant_per_ft double, "
    "fluid_per_ft double, oil array<double>, gas array<double>"
)
CURVE = [100.0, 90.0, 80.0, 70.0, 60.0, 50.0, 40.0, 30.0, 20.0]


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def well(
    well_id,
    basin="dj_basin",
    operator="A",
    formation="NIOBRARA",
    lat=40.3,
    lon=-104.5,
    first="2019-01-01",
    lateral=10000.0,
    ppf=1500.0,
    fpf=50.0,
    oil=None,
    gas=None,
):
    oil = list(CURVE if oil is None else oil)
    gas = list(oil if gas is None else gas)
    return (
        well_id, basin, operator, formation, lat, lon, day(first), lateral, ppf, fpf, oil, gas,
    )


def early(spark, *wells):
    return spark.createDataFrame(list(wells), EARLY)


def rows(df, *columns):
    """Rows as a sorted list of tuples (or of values for one column)."""
    chosen = df.select(*columns) if columns else df
    got = [tuple(r) if len(r) > 1 else r[0] for r in chosen.collect()]
    return sorted(got, key=repr)
