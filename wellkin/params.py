"""Per-basin parameters.

The set of basins is configuration, not data: a handful of rows that never grow
with the input.  Operators read a parameter as a ``CASE basin_name WHEN ...``
column of literals (`BasinSet.value`), so no join is needed, filters built from
them reach the Parquet scan, and one job handles every basin at once.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Basin:
    name: str
    code: str
    title: str
    api_prefixes: tuple[str, ...]
    states: tuple[str, ...]
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    max_distance_miles: float
    lateral_tolerance: float
    min_vintage_year: int
    peak_month_window: int
    formations: tuple[str, ...]
    kappa_length: float
    kappa_proppant: float
    lateral_min: float
    lateral_max: float
    proppant_min: float
    proppant_max: float
    fluid_min: float
    fluid_max: float
    top_k: int
    distance_power: float


# Basin parameters.
DJ_BASIN = Basin(
    name="dj_basin",
    code="dj",
    title="Denver Basin",
    api_prefixes=("05",),
    states=("CO",),
    lat_min=39.51,
    lat_max=42.19,
    lon_min=-105.13,
    lon_max=-101.99,
    max_distance_miles=15.0,
    lateral_tolerance=0.2,
    min_vintage_year=2018,
    peak_month_window=7,
    formations=(
        "Niobrara", "Niobrara A", "Niobrara B", "Niobrara C", "Codell", "Greenhorn",
        "Shannon", "Sussex", "Turner", "Parkman", "Terry", "Hygiene",
    ),
    kappa_length=0.6,
    kappa_proppant=0.2,
    lateral_min=4000.0,
    lateral_max=15000.0,
    proppant_min=500.0,
    proppant_max=3500.0,
    fluid_min=20.0,
    fluid_max=100.0,
    top_k=20,
    distance_power=2.0,
)

# Basin parameters.
BAKKEN = Basin(
    name="bakken",
    code="bakken",
    title="Bakken",
    api_prefixes=("33", "25"),
    states=("ND", "MT"),
    lat_min=46.66,
    lat_max=48.99,
    lon_min=-105.26,
    lon_max=-102.00,
    max_distance_miles=20.0,
    lateral_tolerance=0.2,
    min_vintage_year=2016,
    peak_month_window=6,
    formations=(
        "Bakken", "Middle Bakken", "Three Forks",
        "Three Forks 1st", "Three Forks 2nd", "Three Forks 3rd",
    ),
    kappa_length=0.55,
    kappa_proppant=0.25,
    lateral_min=5000.0,
    lateral_max=12000.0,
    proppant_min=600.0,
    proppant_max=2500.0,
    fluid_min=25.0,
    fluid_max=70.0,
    top_k=20,
    distance_power=2.0,
)


class BasinSet:
    """An ordered, small set of basins plus Column builders over their parameters."""

    def __init__(self, basins):
        self.basins = tuple(basins)
        if not self.basins:
            raise ValueError("at least one basin is required")
        self._by_name = {b.code: b for b in self.basins} | {b.name: b for b in self.basins}

    def __iter__(self):
        return iter(self.basins)

    def get(self, name: str) -> Basin:
        """Basin by name or short code; an unknown name raises."""
        try:
            return self._by_name[name]
        except KeyError:
            raise KeyError(f"unknown basin {name!r}; known: {sorted(self._by_name)}") from None

    def only(self, *names: str) -> BasinSet:
        return BasinSet(self.get(n) for n in names)

    def override(self, **changes) -> BasinSet:
        """The same basins with some parameters replaced in each."""
        return BasinSet(replace(b, **changes) for b in self.basins)

    def sql(self, parameter: str, on: str = "basin_name") -> str:
        """SQL text of a parameter of the row's basin; null where the basin is unknown."""
        cases = [f"WHEN '{b.name}' THEN {_sql(getattr(b, parameter))}" for b in self.basins]
        return f"(CASE {on} {' '.join(cases)} END)"

    def value(self, parameter: str, on: str = "basin_name") -> Column:
        return F.expr(self.sql(parameter, on))

    @staticmethod
    def fence(basin: Basin, state: str, lat: str, lon: str) -> str:
        """SQL test whether a place lies in a basin's states and bounds."""
        states = ", ".join(f"'{s}'" for s in basin.states)
        return (
            f"({state} IN ({states}) AND {lat} BETWEEN {basin.lat_min}D AND {basin.lat_max}D"
            f" AND {lon} BETWEEN {basin.lon_min}D AND {basin.lon_max}D)"
        )

    def in_fence(self, state: str, lat: str, lon: str) -> Column:
        """True where the point lies in any basin: literals only, so the scan sees it."""
        return F.expr(" OR ".join(self.fence(b, state, lat, lon) for b in self.basins))

    def fence_label(self, state: str, lat: str, lon: str, parameter: str) -> Column:
        cases = [
            f"WHEN {self.fence(b, state, lat, lon)} THEN {_sql(getattr(b, parameter))}"
            for b in self.basins
        ]
        return F.expr(f"CASE {' '.join(cases)} END")

    def in_own_fence(self, basin_name: str, state: str, lat: str, lon: str) -> Column:
        """Whether a row lies in the fence of the basin it is labelled with."""
        cases = [
            f"WHEN '{b.name}' THEN {self.fence(b, state, lat, lon)}" for b in self.basins
        ]
        return F.expr(f"CASE {basin_name} {' '.join(cases)} END")

    def api_match(self, well_id: Column, on: str = "basin_name") -> Column:
        """Well id starts with one of its basin's prefixes (no prefixes: always true)."""
        key = F.col(on)
        return self._pick(lambda b: key == b.name, lambda b: prefix_match(well_id, b.api_prefixes))

    def table(self, spark: SparkSession) -> DataFrame:
        """The parameters as a DataFrame, one row per basin."""
        rows = F.array(
            *[
                F.struct(*[_literal(v).alias(k) for k, v in asdict(b).items()])
                for b in self.basins
            ]
        )
        return spark.range(1).select(F.inline(rows))

    @staticmethod
    def names() -> list[str]:
        return [f.name for f in fields(Basin)]

    def _pick(self, test, result) -> Column:
        first, *rest = self.basins
        picked = F.when(test(first), result(first))
        for basin in rest:
            picked = picked.when(test(basin), result(basin))
        return picked


def prefix_match(well_id: Column, prefixes) -> Column:
    """Id starts with any of the prefixes; an empty list filters nothing."""
    if not prefixes:
        return F.lit(True)
    return reduce(Column.__or__, [well_id.startswith(p) for p in prefixes])


def state_match(state: Column, states) -> Column:
    """State is in the list; an empty list filters nothing."""
    return state.isin(*states) if states else F.lit(True)


def _sql(value) -> str:
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def _literal(value) -> Column:
    if isinstance(value, (tuple, list)):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


BASINS = BasinSet([DJ_BASIN, BAKKEN])
MONTHS = 9

# Error weights of months 1-9, oil price, yearly discount rate.
MONTH_WEIGHTS = (3.0, 3.0, 2.0, 2.0, 1.5, 1.5, 1.0, 1.0, 1.0)
OIL_PRICE = 70.0
DISCOUNT_RATE = 0.10


def revenue_weights(months: int = MONTHS) -> list[float]:
    """Discounted monthly price."""
    return [OIL_PRICE / math.pow(1 + DISCOUNT_RATE / 12, i) for i in range(months)]


def early_weights(months: int = MONTHS) -> list[float]:
    """Weights falling by 1 % a month, normalised to sum to one."""
    raw = [1.0 / math.pow(1.01, i) for i in range(months)]
    return [w / sum(raw) for w in raw]
