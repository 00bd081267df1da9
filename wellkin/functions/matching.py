"""Match and validity expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wellkin.params import BasinSet


def target(name: str) -> Column:
    """A column of the target's side of a pair."""
    return F.col(f"target_{name}")


def candidate(name: str) -> Column:
    """A column of the candidate's side of a pair."""
    return F.col(f"candidate_{name}")


def formation_score(formation: Column, wanted: Column) -> Column:
    """1.0 same name, 0.8 contains the target's first word, else 0 (case-blind)."""
    ours, theirs = F.upper(formation), F.upper(wanted)
    first_word = F.split(F.trim(theirs), r"\s+")[0]
    return (
        F.when(ours == theirs, 1.0).when(ours.contains(first_word), 0.8).otherwise(0.0)
    )


def same_formation(a: Column, b: Column) -> Column:
    """Case-blind equality where two missing names match and one missing does not."""
    return F.upper(a).eqNullSafe(F.upper(b))


def same_operator(a: Column, b: Column) -> Column:
    """Equality where a missing name never matches."""
    return F.coalesce(a == b, F.lit(False))


def in_range(value: Column, basins: BasinSet, low: str, high: str) -> Column:
    """Value within the inclusive range of its basin."""
    return value.between(basins.value(low), basins.value(high))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null, not an error, on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def year_gap(later: Column, earlier: Column) -> Column:
    return F.year(later) - F.year(earlier)
