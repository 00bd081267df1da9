"""Pair features (F9-F12, F14-F16): projections only, no joins, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wellkin.functions import series
from wellkin.functions.matching import candidate, target

# Feature order of the ranking vector.
RANKING_FEATURES = (
    "distance_mi",
    "log_distance",
    "length_delta",
    "log_length_ratio",
    "abs_log_length_ratio",
    "ppf_ratio",
    "log_ppf_ratio",
    "same_operator",
    "vintage_gap_years",
    "candidate_peak_oil",
    "peak_oil_ratio",
    "log_peak_oil_ratio",
    "decline_rate_diff",
    "wells_within_1mi_at_start",
    "wells_within_3mi_at_start",
    "distance_to_nearest_at_start",
    "distance_to_second_nearest_at_start",
)

# Distance bucket edges and labels, right-closed.
BUCKETS = (
    (0.0, 1.0, "0-1mi"),
    (1.0, 3.0, "1-3mi"),
    (3.0, 5.0, "3-5mi"),
    (5.0, 10.0, "5-10mi"),
    (10.0, 15.0, "10-15mi"),
)

KM_PER_MILE = 1.60934
DAYS_PER_YEAR = 365.25
TYPICAL_DECLINE = 0.7
TYPICAL_PEAK_MONTH = 3
LOG_FLOOR = 0.1
SEASON_MONTHS = 2


def floored_log(value: Column) -> Column:
    """Natural log of a ratio, held above log(0.1)."""
    return F.ln(F.greatest(value, F.lit(LOG_FLOOR)))


def wide(pairs: DataFrame) -> DataFrame:
    """design, intensity, vintage and season features of a pair."""
    t, c = target, candidate
    month_diff = F.abs(t("vintage_month") - c("vintage_month"))
    return (
        pairs.withColumns(
            {
                "proppant_ratio": c("proppant_per_ft") / (t("proppant_per_ft") + 1),
                "fluid_ratio": c("fluid_per_ft") / (t("fluid_per_ft") + 1),
                "target_oil_per_ft": t("cum_oil") / (t("lateral_length") + 1),
                "candidate_oil_per_ft": c("cum_oil") / (c("lateral_length") + 1),
                "vintage_match": (t("vintage_year") == c("vintage_year")).cast("int"),
                "vintage_gap_abs": F.abs("vintage_gap_years"),
                "month_diff": month_diff,
                "same_season": (month_diff <= SEASON_MONTHS).cast("int"),
            }
        )
        .withColumns(
            {
                "log_lateral_ratio": F.log1p("length_ratio"),
                "log_proppant_ratio": F.log1p("proppant_ratio"),
                "log_fluid_ratio": F.log1p("fluid_ratio"),
                "oil_per_ft_ratio": c("oil_per_ft") / (t("oil_per_ft") + 1),
                "distance_bucket": distance_bucket(F.col("distance_mi")),
                "formation_group": t("formation"),
            }
        )
    )


def distance_bucket(distance: Column) -> Column:
    """label of the right-closed bucket; null at 0 and beyond the last edge."""
    (low, high, label), *rest = BUCKETS
    picked = F.when((distance > low) & (distance <= high), label)
    for low, high, label in rest:
        picked = picked.when((distance > low) & (distance <= high), label)
    return picked


def bucket_columns() -> list[str]:
    return [f"distance_bucket_{label}" for _, _, label in BUCKETS]


def bucket_onehot(pairs: DataFrame) -> DataFrame:
    """one 0/1 column per bucket, always all of them and in edge order."""
    bucket = F.col("distance_bucket")
    return pairs.withColumns(
        {
            f"distance_bucket_{label}": F.coalesce((bucket == label).cast("int"), F.lit(0))
            for _, _, label in BUCKETS
        }
    )


# Column order of the wide training matrix.
WIDE_FEATURES = (
    "distance_mi",
    "length_ratio",
    "log_lateral_ratio",
    "delta_length",
    "proppant_ratio",
    "fluid_ratio",
    "log_proppant_ratio",
    "log_fluid_ratio",
    "formation_match",
    "same_operator",
    "is_major_operator",
    "vintage_gap_years",
    "vintage_gap_abs",
    "vintage_match",
    "same_season",
    "month_diff",
    "candidate_oil_per_ft",
    "oil_per_ft_ratio",
    "target_lateral_length",
    "candidate_lateral_length",
    "target_proppant_per_ft",
    "candidate_proppant_per_ft",
    "target_vintage_year",
    "candidate_vintage_year",
)


def embedding_features(pairs: DataFrame, size: int = 4) -> DataFrame:
    """F8 on a pair: similarity and per-component difference of the two oil embeddings."""
    ours, theirs = target("oil_embedding"), candidate("oil_embedding")
    return pairs.withColumns(
        {"embedding_similarity": series.cosine(ours, theirs)}
        | {f"embedding_diff_{i}": series.component_diff(ours, theirs, i) for i in range(size)}
    )


def matrix(pairs: DataFrame, label: str = "analog_score") -> DataFrame:
    """ids, features in fixed order and label; embedding columns when present."""
    extra = [c for c in pairs.columns if c.startswith(("embedding_similarity", "embedding_diff_"))]
    return pairs.select(
        "target_id", "candidate_id", *WIDE_FEATURES, *bucket_columns(), *extra, label
    )


def group_sizes(pairs: DataFrame) -> DataFrame:
    """candidates per target."""
    return pairs.groupBy("target_id").agg(F.count("*").alias("group_size"))


def ranking17(
    pairs: DataFrame,
    with_peaks: bool = True,
    keep: tuple[str, ...] = (),
    target_peaks: bool = True,
) -> DataFrame:
    """the 17 ranking features after the pair's ids and the ``keep`` columns.

    Needs the pair measures, ``target_lateral_length``, ``target_proppant_per_ft`` and
    ``candidate_proppant_per_ft``; with ``with_peaks`` also both sides' ``peak_oil`` and
    ``oil_decline_rate`` (null where a well has none).  Without ``target_peaks`` only the
    candidate's peak is used and the terms that compare it with the target's own future curve
    take their defaults (1, 0, 0), as for a well that has not produced yet.  Spacing columns
    may be absent; a missing vintage gap is taken from the two start dates, in years of 365.25
    days.
    """
    t, c = target, candidate
    has = set(pairs.columns)
    distance = F.col("distance_mi")

    long_enough = t("lateral_length") > 0
    length_ratio = F.when(long_enough, F.col("length_ratio")).otherwise(1.0)
    log_length = floored_log(length_ratio)

    loaded = F.coalesce(t("proppant_per_ft") > 0, F.lit(False))
    stored = (
        F.col("ppf_ratio")
        if "ppf_ratio" in has
        else t("proppant_per_ft") / (F.coalesce(c("proppant_per_ft"), F.lit(1.0)) + 1)
    )

    peak = F.coalesce(c("peak_oil"), F.lit(0.0)) if with_peaks else F.lit(0.0)
    if with_peaks and target_peaks:
        known = F.coalesce(t("peak_oil") > 0, F.lit(False))
        share = peak / (t("peak_oil") + 1)
        peak_ratio = F.when(known, share).otherwise(1.0)
        log_peak = F.when(known, floored_log(share)).otherwise(0.0)
        typical = F.lit(TYPICAL_DECLINE)
        decline = F.coalesce(c("oil_decline_rate"), typical) - F.coalesce(
            t("oil_decline_rate"), typical
        )
    else:
        peak_ratio, log_peak, decline = (F.lit(v) for v in (1.0, 0.0, 0.0))

    gap = (
        F.col("vintage_gap_years")
        if "vintage_gap_years" in has
        else F.datediff(t("first_prod_date"), c("first_prod_date")) / DAYS_PER_YEAR
    )

    def or_default(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in has else F.lit(default)

    values = {
        "distance_mi": distance,
        "log_distance": F.log1p(distance),
        "length_delta": F.when(long_enough, F.col("delta_length")).otherwise(0.0),
        "log_length_ratio": log_length,
        "abs_log_length_ratio": F.abs(log_length),
        "ppf_ratio": F.when(loaded, stored).otherwise(1.0),
        "log_ppf_ratio": F.when(loaded, floored_log(stored)).otherwise(0.0),
        "same_operator": F.coalesce(F.col("same_operator").cast("int"), F.lit(0)),
        "vintage_gap_years": F.coalesce(gap, F.lit(0)),
        "candidate_peak_oil": peak,
        "peak_oil_ratio": peak_ratio,
        "log_peak_oil_ratio": log_peak,
        "decline_rate_diff": decline,
        "wells_within_1mi_at_start": or_default("wells_within_1mi_at_start", 0),
        "wells_within_3mi_at_start": or_default("wells_within_3mi_at_start", 0),
        "distance_to_nearest_at_start": or_default("distance_to_nearest_at_start", 999.0),
        "distance_to_second_nearest_at_start": or_default(
            "distance_to_second_nearest_at_start", 999.0
        ),
    }
    return pairs.select(
        "target_id",
        "candidate_id",
        *keep,
        *[values[name].cast("double").alias(name) for name in RANKING_FEATURES],
    )


def inference(found: DataFrame, target_year: int) -> DataFrame:
    """features of a planned well's analogs (output of the new-well lookup)."""
    t, c = target, candidate
    distance, gap = F.col("distance_mi"), F.col("vintage_years")

    def band(low: float, high: float) -> Column:
        return ((distance > low) & (distance <= high)).cast("int")

    ppf, fpf = (F.coalesce(n, F.lit(1.0)) for n in ("ppf_ratio", "fpf_ratio"))
    same = F.coalesce((c("operator_name") == t("operator")).cast("int"), F.lit(0))
    match = F.col("formation_match")
    return found.select(
        "target_id",
        "candidate_id",
        distance.alias("distance_miles"),
        (distance <= 5).cast("int").alias("dist_0_5"),
        band(5, 10).alias("dist_5_10"),
        band(10, 15).alias("dist_10_15"),
        "length_ratio",
        F.log1p("length_ratio").alias("log_length_ratio"),
        "delta_length",
        t("lateral_length").alias("target_lateral"),
        c("lateral_length").alias("candidate_lateral"),
        ppf.alias("ppf_ratio"),
        fpf.alias("fpf_ratio"),
        F.log1p(ppf).alias("log_ppf_ratio"),
        F.log1p(fpf).alias("log_fpf_ratio"),
        "formation_match",
        same.alias("same_operator"),
        gap.alias("vintage_gap"),
        (gap * gap).alias("vintage_gap_squared"),
        (gap <= 2).cast("int").alias("recent_vintage"),
        F.lit(target_year).alias("target_year"),
        (F.lit(target_year) - gap).alias("candidate_year"),
        (match * distance).alias("formation_distance"),
        (same * distance).alias("operator_distance"),
    )


def legacy20(pairs: DataFrame, components: int = 4) -> DataFrame:
    """F16: the older feature set, with embedding components (0 when missing) and timing."""
    t, c = target, candidate
    distance = F.col("distance_mi")
    log_length = floored_log(F.col("length_ratio"))
    ppf = t("proppant_per_ft") / (c("proppant_per_ft") + 1)
    gap = F.coalesce("vintage_gap_years", F.lit(0))
    formation = F.coalesce(F.col("formation_match").cast("int"), F.lit(0))
    operator = F.coalesce(F.col("same_operator").cast("int"), F.lit(0))
    typical = F.lit(TYPICAL_PEAK_MONTH)
    vector = (
        F.col("candidate_oil_embedding")
        if "candidate_oil_embedding" in pairs.columns
        else F.lit(None).cast("array<double>")
    )
    return pairs.select(
        "target_id",
        "candidate_id",
        distance,
        (distance * KM_PER_MILE).alias("distance_km"),
        F.log1p(distance).alias("log_distance"),
        "length_ratio",
        F.col("delta_length").alias("length_delta"),
        log_length.alias("log_length_ratio"),
        F.abs(log_length).alias("abs_log_length_ratio"),
        ppf.alias("ppf_ratio"),
        floored_log(ppf).alias("log_ppf_ratio"),
        formation.alias("same_formation"),
        operator.alias("same_operator"),
        gap.alias("vintage_gap_years"),
        F.abs(gap).alias("abs_vintage_gap"),
        *[
            F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)).alias(f"embedding_pc{i + 1}")
            for i in range(components)
        ],
        (distance * formation).alias("distance_x_formation"),
        (distance * operator).alias("distance_x_operator"),
        (F.abs(log_length) * floored_log(ppf)).alias("length_x_ppf"),
        (F.coalesce(c("peak_oil_month"), typical) - F.coalesce(t("peak_oil_month"), typical)).alias(
            "peak_month_diff"
        ),
        F.coalesce((c("peak_oil_month") <= TYPICAL_PEAK_MONTH).cast("int"), F.lit(0)).alias(
            "early_peak"
        ),
    )
