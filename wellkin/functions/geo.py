"""Distance on the WGS84 spheroid as JVM-side SQL expressions.

Trigonometry on coordinates happens once per point (`unit_vector`); a pair then needs only
the squared chord of two unit vectors plus a first-order flattening correction
(Andoyer-Lambert).  Against an iterative geodesic the error stays below a metre at the radii
used here.

The expressions are SQL text, composed before Spark parses them, and shared parts are named
columns of an inner projection: nesting the whole formula in one expression would evaluate
them many times over.
"""

from __future__ import annotations

SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
METRES_PER_MILE = 1609.34

# Widening of the spherical radius test that covers the spheroid.
SPHERE_SLACK = 1.004

# Lower bounds of miles per degree, so that a grid cell is never too small.
MILES_PER_LAT_DEGREE = 68.7
MILES_PER_LON_DEGREE = 69.17


def reduced_latitude(lat: str) -> str:
    return f"atan({1 - FLATTENING!r}D * tan(radians({lat})))"


def unit_vector(beta: str, lon: str, names: tuple[str, str, str]) -> str:
    """Select list of the unit vector at a reduced latitude and a longitude.

    A missing coordinate gives NaN, which is near nothing: columns that cannot be null keep null
    tests out of the code of a join, where they would outnumber the arithmetic.
    """
    parts = (
        f"cos({beta}) * cos(radians({lon}))",
        f"cos({beta}) * sin(radians({lon}))",
        f"sin({beta})",
    )
    return ", ".join(f"coalesce({p}, double('NaN')) AS {n}" for p, n in zip(parts, names))


def half_chord_sq(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    """sin^2 of half the central angle: three subtractions and three products."""
    squares = [f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b)]
    return f"({' + '.join(squares)}) / 4"


def half_chord_limit(radius_miles: str) -> str:
    """Upper bound of `half_chord_sq` for points within the radius."""
    half_angle = f"{radius_miles} * {SPHERE_SLACK * METRES_PER_MILE / (2 * SEMI_MAJOR_M)!r}D"
    return f"sin({half_angle}) * sin({half_angle})"


def miles(h: str, sigma: str, sine: str, za: str, zb: str) -> str:
    """Distance from the half chord, the central angle, its sine and the two z components."""
    middle, half_gap = f"(({za} + {zb}) / 2)", f"(({zb} - {za}) / 2)"
    bend = (
        f"(({sigma} - {sine}) * {middle} * {middle} / (1 - {h})"
        f" + ({sigma} + {sine}) * {half_gap} * {half_gap} / nullif({h}, 0D))"
    )
    metres = f"{SEMI_MAJOR_M}D * ({sigma} - {FLATTENING / 2!r}D * {bend})"
    return f"coalesce({metres} / {METRES_PER_MILE}D, 0D)"


def distance_mi(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    """The spheroidal distance as one expression.

    It repeats the half chord, so a join should test it last, on the few pairs that the
    cheap chord test lets through; a select list should name the parts and use `miles`.
    """
    h = f"({half_chord_sq(a, b)})"
    return miles(h, f"(2 * asin(sqrt({h})))", f"(2 * sqrt({h} * (1 - {h})))", a[2], b[2])


def lat_band(lat: str, radius_miles: str) -> str:
    """Grid row: bands at least one radius high."""
    return f"floor({lat} / ({radius_miles} / {MILES_PER_LAT_DEGREE}D))"


def band_width(band: str, radius_miles: str) -> str:
    """Cell width (degrees of longitude) of a band, at least one radius wide.

    The cosine is taken one whole band beyond the neighbours' poleward edge, so three
    adjacent columns always cover the radius.
    """
    edge = f"least(89D, (abs({band}) + 2) * ({radius_miles} / {MILES_PER_LAT_DEGREE}D))"
    return f"({radius_miles} / ({MILES_PER_LON_DEGREE}D * cos(radians({edge}))))"
