"""The workload's steps over the bound test tables, in order.

Functions named after a table return it; `early_rates`, `candidates` and so on are stored
between steps (see `stored`), the ingest steps are lazy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from wellkin.operators import (
    baseline,
    candidates as pairs_of,
    curves,
    embeddings,
    evaluate,
    labels,
    lookup,
    peaks as peak_features,
    production,
    ranker,
    spacing as spacing_of,
    wells as headers,
)
from wellkin.plans.stored import Steps
from wellkin.sources import bindings, merge


def raw_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.well_headers(spark, sf_dir)


def ingest_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned headers before production dates are known."""
    return headers.standardise(
        headers.filter_label(
            raw_wells(spark, sf_dir), bindings.BOUND_BASINS, bindings.SPUD_FLOOR
        )
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per well and date, of known wells."""
    feeds = production.union_feeds(
        bindings.liquids_feed(spark, sf_dir),
        bindings.gas_feed(spark, sf_dir),
        bindings.PRODUCTION_FLOOR,
    )
    return production.monthly_max(production.of_wells(feeds, ingest_wells(spark, sf_dir)))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production.month_index(production.history_gate(monthly(spark, sf_dir)))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production table, computed from the feeds."""
    return production.build(
        bindings.liquids_feed(spark, sf_dir),
        bindings.gas_feed(spark, sf_dir),
        ingest_wells(spark, sf_dir),
        bindings.PRODUCTION_FLOOR,
    )


def model_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Steps.of(spark, sf_dir).table("model_prod", lambda: aligned(spark, sf_dir))


def model_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with first production dates from the aligned production."""
    return Steps.of(spark, sf_dir).table(
        "model_wells",
        lambda: merge.update_from(
            ingest_wells(spark, sf_dir),
            production.first_dates(model_prod(spark, sf_dir)),
            ["well_id"],
            ["first_prod_date"],
        ),
    )


def curves_from(
    prod: DataFrame, wells: DataFrame, max_zero: int = 2, max_history_zero: int | None = 2
) -> DataFrame:
    return curves.early_rates(
        prod, wells, bindings.BOUND_BASINS, max_zero=max_zero, max_history_zero=max_history_zero
    )


def early_rates(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Early curves; the ``dense`` ones are those of the same wells drawn closer together."""
    made = Steps.of(spark, sf_dir).table(
        "early_rates",
        lambda: curves_from(model_prod(spark, sf_dir), ingest_wells(spark, sf_dir)),
    )
    return bindings.drawn_together(made) if dense else made


def spacing(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return Steps.of(spark, sf_dir).table(
        "spacing_dense" if dense else "spacing",
        lambda: spacing_of.at_start(early_rates(spark, sf_dir, dense), bindings.BOUND_BASINS),
    )


def _candidates_name(dense: bool) -> str:
    return "analog_candidates_dense" if dense else "analog_candidates"


def _formed(spark: SparkSession, sf_dir: str, dense: bool) -> DataFrame:
    return pairs_of.build(
        early_rates(spark, sf_dir, dense), bindings.BOUND_BASINS, spacing(spark, sf_dir, dense)
    )


def candidates(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return Steps.of(spark, sf_dir).table(
        _candidates_name(dense),
        lambda: _formed(spark, sf_dir, dense),
        partition_by="basin_name",
    )


def candidates_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates for a query that reads them once or twice: the stored table if there is one,
    else the pairs as they are formed, which costs less than writing them with all their columns;
    written, they grow with the square of the wells."""
    made = Steps.of(spark, sf_dir).table_if_made(_candidates_name(dense=False))
    return _formed(spark, sf_dir, dense=False) if made is None else made


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve embeddings of the early-curve wells."""
    return Steps.of(spark, sf_dir).table(
        "embeddings", lambda: embeddings.fit_transform(early_rates(spark, sf_dir))
    )


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Steps.of(spark, sf_dir).table(
        "peak_features", lambda: peak_features.features(early_rates(spark, sf_dir))
    )


def training(
    spark: SparkSession, sf_dir: str, dense: bool = False, pairs: DataFrame | None = None
) -> DataFrame:
    """The training pairs.  Those of the dense fields are read many times, so their candidates are stored."""
    if pairs is None:
        pairs = candidates(spark, sf_dir, dense) if dense else candidates_once(spark, sf_dir)
    return pairs_of.training_pairs(
        pairs,
        early_rates(spark, sf_dir, dense),
        peaks(spark, sf_dir),
        bindings.TRAINING_YEARS,
    )


def training_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training pairs for a query that reads them once."""
    return training(spark, sf_dir, pairs=candidates_once(spark, sf_dir))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored labels of the training pairs: rankings read them several times."""
    return Steps.of(spark, sf_dir).table(
        "training_graded",
        lambda: labels.graded(training(spark, sf_dir)).select(
            "target_id", "candidate_id", "distance_mi", "revenue_error", "label"
        ),
    )


def training_alt(
    spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None
) -> DataFrame:
    return pairs_of.training_pairs_alt(
        candidates_once(spark, sf_dir),
        early_rates(spark, sf_dir),
        vectors,
        before=bindings.ALTERNATE_CUT,
    )


def ranker_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored training matrix of the dense fields with graded labels; targets are split inside
    their basin."""

    def build():
        made = ranker.training_features(labels.graded(training(spark, sf_dir, dense=True)))
        parts = [
            labels.split(made.filter(F.col("basin_name") == b.name)) for b in bindings.BOUND_BASINS
        ]
        return reduce(DataFrame.unionByName, parts)

    return Steps.of(spark, sf_dir).table("ranker_training", build, partition_by="basin_name")


def rank_models(spark: SparkSession, sf_dir: str) -> dict[str, ranker.RankModel]:
    """One model per basin with the full settings, trained once per application."""

    def parts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        return pairs.filter("split = 'train'"), pairs.filter("split = 'valid'")

    return Steps.of(spark, sf_dir).once(
        "rank_models",
        lambda: ranker.fit_basins(ranker_pairs(spark, sf_dir), bindings.BOUND_BASINS, parts),
    )


def rank_scorer(spark: SparkSession, sf_dir: str):
    """Scores the pairs of a lookup by the model of their basin."""
    known = peaks(spark, sf_dir), spacing(spark, sf_dir, dense=True)
    return ranker.scorer(rank_models(spark, sf_dir), *known)


def nearest_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = early_rates(spark, sf_dir)
    return lookup.analogs(early, early, bindings.BOUND_BASINS)


def baseline_forecast(early: DataFrame) -> DataFrame:
    """Median forecast of every early-curve well from its nearest earlier analogs."""
    found = lookup.analogs(early, early, bindings.BOUND_BASINS)
    return baseline.median(lookup.with_curves(found, early))


def baseline_scores(early: DataFrame) -> DataFrame:
    """Weighted error of the baseline forecast of every early-curve well."""
    return evaluate.score(baseline_forecast(early), early)


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors alone, stored: the statistics read them several times."""
    return Steps.of(spark, sf_dir).table(
        "baseline_scores",
        lambda: baseline_scores(early_rates(spark, sf_dir)).select(
            "target_id", "basin_name", "n_analogs", "weighted_mae"
        ),
    )


def test_wells(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    made = evaluate.test_wells(
        model_wells(spark, sf_dir), model_prod(spark, sf_dir), bindings.TEST_YEAR
    )
    return bindings.drawn_together(made) if dense else made


# Exact multiples of cents fall on rounding ties that engines break differently.
_NUDGE = 1e-7


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column, off exact ties, so results compare across engines."""
    return df.select(
        *[
            F.round(F.col(name) + _NUDGE, digits).alias(name)
            if kind in ("double", "float")
            else F.col(name)
            for name, kind in df.dtypes
        ]
    )
