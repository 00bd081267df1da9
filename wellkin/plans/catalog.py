"""The registered queries: one per operator, over the bound test tables.

Every query reads whole tables.  Floating results are rounded to four digits and arrays are
spread to one row per month, so another engine can check them value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from wellkin.functions import series
from wellkin.functions.matching import formation_score
from wellkin.operators import (
    baseline,
    candidates,
    curves,
    embeddings,
    evaluate,
    features,
    forecast,
    labels,
    lookup,
    peaks,
    production,
    quality,
    ranker,
    select,
    spacing,
    wells,
)
from wellkin.params import state_match
from wellkin.plans import steps
from wellkin.plans.steps import rounded
from wellkin.plans.stored import fresh_path
from wellkin.sources import bindings, files, merge, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASINS = bindings.BOUND_BASINS


# Sums in the millions: four digits would compare rounding noise.
_COARSE = {"forecast_json_round_trip", "softmax_forecast", "batch_forecast", "forecast_long_export", "forecast_summary"}


def query(build: Query) -> Query:
    name = build.__name__
    digits = 2 if name in _COARSE else 4
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir), digits)
    return build


def spread(df: DataFrame, *curves_: str) -> DataFrame:
    """One row per element of the named arrays, months counted from 1."""
    rest = [c for c in df.columns if c not in curves_]
    return df.select(*rest, F.posexplode(F.arrays_zip(*curves_)).alias("_p", "_v")).select(
        *rest, (F.col("_p") + 1).alias("month"), *[F.col(f"_v.{c}").alias(c) for c in curves_]
    )


# Ingest -----------------------------------------------------------------------------------


@query
def basin_filter_label(spark, sf):
    labelled = wells.filter_label(steps.raw_wells(spark, sf), BASINS, bindings.SPUD_FLOOR)
    return labelled.select(
        "well_api", "state_abbr", "surface_lat", "surface_lng", "spud_date", "basin", "basin_name"
    )


@query
def wells_standardised(spark, sf):
    return steps.ingest_wells(spark, sf).drop("created_at", "sub_basin", "first_prod_date")


@query
def wells_by_basin(spark, sf):
    return wells.by_basin(steps.ingest_wells(spark, sf))


def _legacy(spark, sf):
    return wells.clean_legacy(bindings.legacy_headers(spark, sf), bindings.LEGACY_FLOOR)


@query
def legacy_well_clean(spark, sf):
    days = ("first_prod_date", "spud_date", "permit_date")
    return _legacy(spark, sf).withColumns({d: F.to_date(d) for d in days})


@query
def rig_clean(spark, sf):
    days = ("last_reported", "spud_date", "permit_date")
    return (
        wells.clean_rigs(bindings.rigs(spark, sf))
        .drop("created_at")
        .withColumns({d: F.to_date(d) for d in days})
    )


@query
def legacy_denver_count(spark, sf):
    return wells.well_count(wells.legacy_denver(_legacy(spark, sf), bindings.SPUD_FLOOR))


@query
def dj_view(spark, sf):
    view = wells.horizontal_subset(_legacy(spark, sf), bindings.SPUD_FLOOR)
    wells.publish_view(view, "dj_basin_wells")
    return spark.sql("SELECT well_id, lat, lon, lateral_length, formation FROM dj_basin_wells")


@query
def formation_match_score(spark, sf):
    names = BASINS.table(spark).select(
        F.col("name").alias("basin_name"), F.explode("formations").alias("target")
    )
    return (
        steps.ingest_wells(spark, sf)
        .select("well_id", "basin_name", "formation")
        .join(F.broadcast(names), "basin_name")
        .select("well_id", "target", formation_score(F.col("formation"), F.col("target")).alias("score"))
    )


@query
def completion_validity(spark, sf):
    designed = steps.ingest_wells(spark, sf).withColumns(
        {
            "proppant_per_ft": wells.per_foot("proppant_lbs"),
            "fluid_per_ft": wells.per_foot("fluid_gals"),
        }
    )
    flags = ("lateral_length_valid", "proppant_valid", "fluid_valid")
    return wells.completion_flags(designed, BASINS).select(
        "well_id", *[F.col(f).cast("int").alias(f) for f in flags]
    )


@query
def api_and_state_match(spark, sf):
    every_state = [s for b in BASINS for s in b.states]
    return steps.ingest_wells(spark, sf).select(
        "well_id",
        BASINS.api_match(F.col("well_id")).cast("int").alias("api_ok"),
        state_match(F.col("state"), every_state).cast("int").alias("state_ok"),
    )


# Production -------------------------------------------------------------------------------


@query
def production_union_max(spark, sf):
    return steps.monthly(spark, sf)


@query
def history_gate(spark, sf):
    return production.history_gate(steps.monthly(spark, sf))


@query
def month_index(spark, sf):
    return steps.indexed(spark, sf).select(
        "well_id", "prod_date", "true_first_prod_date", "month_index"
    )


@query
def peak_month(spark, sf):
    return production.peak_month(steps.indexed(spark, sf))


@query
def peak_distribution(spark, sf):
    return production.peak_distribution(production.peak_month(steps.indexed(spark, sf)))


@query
def peak_aligned(spark, sf):
    return steps.aligned(spark, sf).drop("created_at", "water_bbls")


@query
def production_by_basin(spark, sf):
    return production.distribution(steps.model_prod(spark, sf))


@query
def first_prod_update(spark, sf):
    return steps.model_wells(spark, sf).select("well_id", "first_prod_date")


# Curves -----------------------------------------------------------------------------------


@query
def early_eligible(spark, sf):
    chosen = curves.eligible(steps.model_prod(spark, sf), steps.ingest_wells(spark, sf), BASINS)
    return chosen.drop("oil_curve", "gas_curve")


@query
def early_newest(spark, sf):
    chosen = curves.eligible(steps.model_prod(spark, sf), steps.ingest_wells(spark, sf), BASINS)
    return curves.newest(chosen, 25).select("well_id", "first_prod_date", "months_available")


def _early_from_feeds(spark, sf):
    return steps.curves_from(steps.aligned(spark, sf), steps.ingest_wells(spark, sf))


@query
def early_rates_scalar(spark, sf):
    arrays = ("oil", "gas", "oil_norm", "gas_norm", "oil_log", "gas_log")
    return _early_from_feeds(spark, sf).drop(*arrays)


@query
def early_rates_long(spark, sf):
    return curves.long_form(_early_from_feeds(spark, sf))


@query
def early_stats(spark, sf):
    return curves.stats(steps.early_rates(spark, sf))


@query
def monthly_series(spark, sf):
    return spread(curves.monthly_series(steps.model_prod(spark, sf)), "oil", "gas")


# Pairs ------------------------------------------------------------------------------------


@query
def candidate_pairs(spark, sf):
    return candidates.match(steps.early_rates(spark, sf), BASINS).select(
        "basin_name", "target_id", "candidate_id", "distance_mi"
    )


@query
def candidate_measures(spark, sf):
    early = steps.early_rates(spark, sf)
    flags = ("formation_match", "same_operator")
    return (
        candidates.build(early, BASINS, steps.spacing(spark, sf))
        .drop("target_first_prod_date", "candidate_first_prod_date")
        .withColumns({f: F.col(f).cast("int") for f in flags})
    )


@query
def candidate_stats(spark, sf):
    return candidates.stats(steps.candidates(spark, sf))


@query
def candidates_per_target(spark, sf):
    return candidates.per_target(steps.candidates_once(spark, sf))


@query
def candidate_top(spark, sf):
    best = candidates.top(steps.candidates_once(spark, sf), steps.early_rates(spark, sf))
    volumes = [f"candidate_{c}" for c in ("avg_oil", "avg_gas", "cum_oil", "cum_gas")]
    return best.select("target_id", "candidate_id", "rank", "distance_mi", *volumes)


@query
def spacing_at_start(spark, sf):
    return spacing.at_start(steps.early_rates(spark, sf), BASINS)


_FOUND = ["target_id", "candidate_id", "analog_rank", "distance_mi"]


@query
def knn_lookup(spark, sf):
    return steps.nearest_analogs(spark, sf).select(*_FOUND, "basin_name", "formation", "length_ratio")


@query
def newwell_lookup(spark, sf):
    found = lookup.new_well(
        bindings.forecast_requests(spark, sf),
        steps.early_rates(spark, sf),
        as_of_year=bindings.AS_OF_YEAR,
    )
    return found.select(
        *_FOUND,
        "length_ratio",
        "delta_length",
        "formation_match",
        "ppf_ratio",
        "fpf_ratio",
        "vintage_years",
    )


def _evaluation_pairs(spark, sf):
    return lookup.evaluation(steps.test_wells(spark, sf), steps.early_rates(spark, sf))


@query
def eval_lookup(spark, sf):
    return _evaluation_pairs(spark, sf).select(
        *_FOUND,
        "length_ratio",
        "same_operator",
        "vintage_gap_years",
        "ppf_ratio",
        "fpf_ratio",
    )


@query
def training_pairs(spark, sf):
    peak = ["peak_oil", "peak_gas", "peak_oil_month", "oil_decline_rate"]
    return steps.training_once(spark, sf).select(
        "target_id",
        "candidate_id",
        series.total(F.col("target_oil")).alias("target_cum"),
        series.total(F.col("candidate_oil")).alias("candidate_cum"),
        "target_lateral_length",
        "candidate_proppant_per_ft",
        *[f"{side}_{c}" for side in ("target", "candidate") for c in peak],
    )


@query
def training_targets(spark, sf):
    return candidates.first_targets(steps.training_once(spark, sf), 20)


@query
def training_pairs_alt(spark, sf):
    return steps.training_alt(spark, sf).select(
        "target_id",
        "candidate_id",
        "distance_mi",
        *[
            f"{side}_{c}"
            for side in ("target", "candidate")
            for c in ("vintage_year", "vintage_month", "fluid_per_ft", "cum_gas", "avg_oil")
        ],
    )


# Selection --------------------------------------------------------------------------------


def _scored(pairs):
    """Pairs with a stand-in score: nearer and better matched is higher."""
    bonus = F.when(F.col("formation_match"), 2.0).otherwise(0.0)
    return pairs.withColumn(
        "score", F.round(bonus - F.abs(1 - F.col("length_ratio")) * 10, 1)
    )


@query
def nearest_topk(spark, sf):
    return select.nearest(steps.candidates_once(spark, sf), 20).select(*_FOUND)


@query
def best_topk(spark, sf):
    return select.best(_scored(steps.candidates_once(spark, sf))).select(*_FOUND, "score")


@query
def operator_diverse_topk(spark, sf):
    return select.diverse(_scored(steps.candidates_once(spark, sf))).select(*_FOUND, "score", "candidate_operator_name")


@query
def major_operator_flag(spark, sf):
    flagged = select.flag_top_categories(steps.candidates_once(spark, sf), "candidate_operator_name")
    return flagged.select(
        "target_id", "candidate_id", "candidate_operator_name", "is_major_operator"
    )


# Quality ----------------------------------------------------------------------------------


@query
def validate_suite(spark, sf):
    return quality.validate(steps.model_wells(spark, sf), steps.model_prod(spark, sf), BASINS)


@query
def validate_broken(spark, sf):
    """The same checks on tables with faults: shifted labels, dates and places."""
    k = F.substring("well_id", 3, 8).cast("bigint")
    broken_wells = steps.model_wells(spark, sf).withColumns(
        {
            "first_prod_date": F.when(k % 7 == 0, F.date_add("first_prod_date", 31)).otherwise(
                F.col("first_prod_date")
            ),
            "lat": F.when(k % 11 == 0, F.lit(10.0)).otherwise(F.col("lat")),
        }
    )
    broken_prod = steps.model_prod(spark, sf).withColumn(
        "basin", F.when(k % 13 == 0, "other").otherwise(F.col("basin"))
    ).filter((k % 17 != 0) | (F.col("prod_month") < 5))
    return quality.validate(broken_wells, broken_prod, BASINS)


@query
def date_mismatches(spark, sf):
    shifted = merge.update_from(
        steps.ingest_wells(spark, sf),
        steps.monthly(spark, sf).groupBy("well_id").agg(F.min("prod_date").alias("first_prod_date")),
        ["well_id"],
        ["first_prod_date"],
    )
    return quality.date_mismatches(shifted, steps.model_prod(spark, sf))


@query
def volume_summary(spark, sf):
    return quality.volume_summary(steps.model_wells(spark, sf), steps.model_prod(spark, sf))


@query
def well_date_ranges(spark, sf):
    return quality.well_date_ranges(steps.model_wells(spark, sf))


@query
def production_date_ranges(spark, sf):
    return quality.production_date_ranges(steps.model_prod(spark, sf))


@query
def completeness(spark, sf):
    return quality.completeness(steps.model_wells(spark, sf))


@query
def first_date_coverage(spark, sf):
    return quality.first_date_coverage(
        steps.ingest_wells(spark, sf), steps.model_wells(spark, sf)
    )


@query
def production_coverage(spark, sf):
    return quality.coverage(steps.model_wells(spark, sf), steps.model_prod(spark, sf))


@query
def zero_month_impact(spark, sf):
    """Impact of a rule of no zero months on curves built with up to nine."""
    loose = steps.curves_from(
        steps.model_prod(spark, sf), steps.ingest_wells(spark, sf), 9, None
    )
    return quality.zero_month_impact(loose, 0)


@query
def wells_without_production(spark, sf):
    return quality.without_production(steps.model_wells(spark, sf), steps.model_prod(spark, sf))


@query
def outer_reconcile(spark, sf):
    return quality.reconcile(steps.model_wells(spark, sf), steps.model_prod(spark, sf))


# Stored-table updates ---------------------------------------------------------------------


@query
def upsert_partial(spark, sf):
    """Even wells stored, wells not divisible by three arriving: two columns are replaced."""
    k = F.substring("well_id", 3, 8).cast("bigint")
    early = steps.early_rates(spark, sf).select(
        "well_id", "basin_name", "operator_name", "cum_oil", "cum_gas"
    )
    stored = early.filter(k % 2 == 0)
    arriving = early.filter(k % 3 != 0).withColumns(
        {"operator_name": F.lit("changed"), "cum_oil": F.col("cum_oil") + 1.0}
    )
    path = fresh_path(spark, "upsert")
    versions.publish(stored, path)
    versions.publish_upsert(arriving, path, ["well_id"], ["basin_name", "cum_oil"])
    return versions.read(spark, path)


@query
def partition_replace(spark, sf):
    """Publish one basin of a stored table anew; the other basin keeps its rows."""
    path = fresh_path(spark, "replace")
    table = steps.early_rates(spark, sf).select("well_id", "cum_oil", "basin_name")
    versions.publish(table, path)
    versions.publish(
        table.filter("basin_name = 'bakken'").withColumn("cum_oil", F.col("cum_oil") * 2), path
    )
    return versions.read(spark, path)


# Round trips ------------------------------------------------------------------------------


@query
def training_round_trip(spark, sf):
    """The training matrix written, and read back with every Parquet file below its folder."""
    pairs = features.ranking17(steps.training(spark, sf), keep=("basin_name",))
    path = fresh_path(spark, "training")
    columns = [c for c in pairs.columns if c not in ("target_id", "candidate_id", "basin_name")]
    files.write_training(pairs, path, columns, "basin_name")
    return files.read_parquet(spark, f"{path}/matrix").drop("basin_name")


@query
def forecast_json_round_trip(spark, sf):
    """The batch forecast exported as JSON objects and read back from them."""
    path = fresh_path(spark, "forecasts")
    made = _batch(spark, sf)
    files.write_forecast_json(made, path)
    read = spark.read.schema(files.forecast_struct(made).schema).json(path)
    return read.select(
        "well_id",
        "input.formation",
        "input.proppant_per_ft",
        "input.fluid_per_ft",
        "error",
        "n_analogs",
        *[f"forecast.{p}_cum_9mo" for p in ("p10", "p50", "p90")],
        "metadata.avg_distance_mi",
    )


@query
def request_round_trip(spark, sf):
    """Forecast requests written as JSON lines, absent fields left out, and read back."""
    path = fresh_path(spark, "requests")
    bindings.forecast_requests(spark, sf).write.json(path)
    return files.read_requests(spark, path)


# Features ---------------------------------------------------------------------------------


@query
def peak_features(spark, sf):
    return peaks.features(steps.early_rates(spark, sf))


@query
def peak_summary(spark, sf):
    return peaks.summary(steps.peaks(spark, sf))


@query
def peak_by_basin(spark, sf):
    return peaks.by_basin(steps.peaks(spark, sf))


@query
def peak_month_histogram(spark, sf):
    return peaks.month_histogram(steps.peaks(spark, sf))


@query
def wide_pair_features(spark, sf):
    made = features.wide(steps.training_alt(spark, sf))
    return made.select(
        "target_id",
        "candidate_id",
        "proppant_ratio",
        "fluid_ratio",
        "log_lateral_ratio",
        "log_proppant_ratio",
        "log_fluid_ratio",
        "target_oil_per_ft",
        "candidate_oil_per_ft",
        "oil_per_ft_ratio",
        "vintage_match",
        "vintage_gap_abs",
        "month_diff",
        "same_season",
        "formation_group",
    )


@query
def distance_bucket_onehot(spark, sf):
    bucketed = steps.candidates_once(spark, sf).withColumn(
        "distance_bucket", features.distance_bucket(F.col("distance_mi"))
    )
    plain = {f"distance_bucket_{label}": f"bucket_{i}" for i, (_, _, label) in enumerate(features.BUCKETS)}
    return (
        features.bucket_onehot(bucketed)
        .withColumnsRenamed(plain)
        .select("target_id", "candidate_id", "distance_bucket", *plain.values())
    )


def _training_matrix(spark, sf):
    pairs = steps.training_alt(spark, sf, steps.embedded(spark, sf))
    made = features.embedding_features(features.bucket_onehot(features.wide(pairs)))
    flagged = select.flag_top_categories(made, "candidate_operator_name")
    flagged = flagged.withColumns(
        {f: F.col(f).cast("int") for f in ("formation_match", "same_operator")}
    )
    return features.matrix(labels.pair_score(flagged))


@query
def training_matrix(spark, sf):
    """The wide matrix, averaged per target; bucket columns keep their fixed order."""
    made = _training_matrix(spark, sf)
    numeric = [c for c in made.columns if c not in ("target_id", "candidate_id")]
    means = [
        F.avg(F.col(f"`{c}`")).alias(f"mean_{i:02d}") for i, c in enumerate(numeric)
    ]
    return made.groupBy("target_id").agg(F.count("*").alias("pairs"), *means)


@query
def group_sizes(spark, sf):
    return features.group_sizes(steps.training_once(spark, sf))


@query
def ranking_features_17(spark, sf):
    return features.ranking17(steps.training(spark, sf))


@query
def ranking_features_no_peaks(spark, sf):
    return features.ranking17(_evaluation_pairs(spark, sf), with_peaks=False)


@query
def inference_features(spark, sf):
    found = lookup.new_well(
        bindings.forecast_requests(spark, sf),
        steps.early_rates(spark, sf),
        as_of_year=bindings.AS_OF_YEAR,
    )
    return features.inference(found, bindings.AS_OF_YEAR)


@query
def legacy_features_20(spark, sf):
    """The older features of the training pairs, with the candidate's embedding."""
    known = steps.embedded(spark, sf)
    return features.legacy20(
        candidates.with_optional(steps.training(spark, sf), known, "candidate", ["oil_embedding"])
    )


@query
def embedding_cosine(spark, sf):
    """Each vector against the first vector of its label."""
    vectors = bindings.curve_vectors(spark, sf)
    first = vectors.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("target_oil_embedding")
    )
    pairs = vectors.withColumnRenamed("embedding", "candidate_oil_embedding").join(first, "label")
    return features.embedding_features(pairs).drop(
        "target_oil_embedding", "candidate_oil_embedding"
    )


@query
def pca_embedding(spark, sf):
    made = steps.embedded(spark, sf)
    return made.select(
        "well_id",
        *[F.get(f"{f}_embedding", F.lit(i)).alias(f"{f}_pc{i + 1}") for f in ("oil", "gas") for i in range(4)],
        "oil_explained_var",
        "gas_explained_var",
    )


@query
def curve_validity(spark, sf):
    """Wells and log-curve months that qualify for an embedding, per fluid."""
    early = steps.early_rates(spark, sf)
    both = [
        spread(embeddings.prepared(early, fluid).withColumn("fluid", F.lit(fluid)), "curve")
        for fluid in ("oil", "gas")
    ]
    return both[0].unionByName(both[1])


@query
def embedding_summary(spark, sf):
    return embeddings.summary(steps.embedded(spark, sf))


@query
def pca_top_months(spark, sf):
    model = embeddings.fit(embeddings.prepared(steps.early_rates(spark, sf), "oil"))
    return embeddings.top_months(model.loadings(spark))


# Labels -----------------------------------------------------------------------------------


@query
def pair_score_labels(spark, sf):
    return labels.pair_score(steps.training_alt(spark, sf)).select(
        "target_id", "candidate_id", "production_error", "analog_score", "is_good_analog"
    )


@query
def good_pair_share(spark, sf):
    scored = labels.pair_score(steps.training_alt(spark, sf))
    return scored.agg(
        F.count("*").alias("pairs"),
        F.avg("is_good_analog").alias("good_share"),
        F.avg("analog_score").alias("mean_score"),
    )


@query
def graded_labels(spark, sf):
    return labels.graded(steps.training(spark, sf)).select(
        "target_id", "candidate_id", "revenue_error", "label"
    )


@query
def train_valid_split(spark, sf):
    return labels.split(steps.training(spark, sf)).select("target_id", "candidate_id", "split")


# Ranker -----------------------------------------------------------------------------------
#
# The trained models see the dense fields: the bound wells, closer together, so that targets
# have enough analogs for trees to split at the real settings.


def _validation_scores(spark, sf):
    add = ranker.by_basin(steps.rank_models(spark, sf), lambda model: model.transform)
    return add(steps.ranker_pairs(spark, sf).filter("split = 'valid'"))


@query
def lambdarank_scores(spark, sf):
    """Validation pairs of every basin, scored by the basin's model."""
    return _validation_scores(spark, sf).select(
        "basin_name", "target_id", "candidate_id", "label", "score"
    )


@query
def lambdarank_metrics(spark, sf):
    """NDCG and MAP of the trained scores, over the validation targets of each basin."""
    per_target = ranker.target_metrics(_validation_scores(spark, sf))
    basins = steps.ranker_pairs(spark, sf).select("target_id", "basin_name").distinct()
    return (
        per_target.join(basins, "target_id")
        .groupBy("basin_name")
        .agg(F.count("*").alias("targets"), F.avg("ndcg").alias("ndcg"), F.avg("map").alias("map"))
    )


def _model_chosen(spark, sf):
    """Test wells' analogs scored by the trained models, cut to twenty and warped."""
    early = steps.early_rates(spark, sf, dense=True)
    found = lookup.evaluation(steps.test_wells(spark, sf, dense=True), early)
    scored = steps.rank_scorer(spark, sf)(found.drop("analog_rank"))
    return forecast.warped(lookup.with_curves(select.best(scored, 20), early))


@query
def lambdarank_forecast(spark, sf):
    """Mean of the warped curves of each test well's twenty best analogs by the model."""
    return spread(forecast.ranked_mean(_model_chosen(spark, sf)), "p50_oil")


@query
def feature_importance(spark, sf):
    """The ten most important features of each basin's model."""
    lists = [
        model.importance(spark).withColumn("basin_name", F.lit(basin))
        for basin, model in steps.rank_models(spark, sf).items()
    ]
    return reduce(DataFrame.unionByName, lists)


@query
def lambda_gradients(spark, sf):
    """Gradient and curvature of every training pair when pairs are ranked by nearness."""
    pairs = steps.graded(spark, sf).select(
        "target_id", "candidate_id", "label", (-F.col("distance_mi")).alias("score")
    )
    ideal = ranker.ideal_dcg(pairs).select("target_id", "ideal")
    return ranker.lambdas(pairs.join(ideal, "target_id")).select(
        "target_id", "candidate_id", "lam", "curvature"
    )


@query
def ranking_metrics(spark, sf):
    """NDCG and MAP per target when pairs are ranked by nearness."""
    pairs = steps.graded(spark, sf).withColumn("score", -F.col("distance_mi"))
    return ranker.target_metrics(pairs)


@query
def ranking_metrics_mean(spark, sf):
    pairs = steps.graded(spark, sf).withColumn("score", -F.col("distance_mi"))
    return ranker.metrics(pairs)


# Forecasts --------------------------------------------------------------------------------


@query
def baseline_median_forecast(spark, sf):
    return spread(steps.baseline_forecast(steps.early_rates(spark, sf)), "p50_oil")


@query
def baseline_batch(spark, sf):
    """One row per early-curve well, with the error where no analog exists."""
    early = steps.early_rates(spark, sf)
    made = baseline.with_errors(
        early.select("well_id", "basin_name"), steps.baseline_forecast(early)
    )
    return made.select(
        "well_id",
        "basin_name",
        "n_analogs",
        "avg_distance_mi",
        "formation_match_pct",
        "error",
        series.total(F.col("p50_oil")).alias("p50_cum"),
    )


@query
def idw_forecast(spark, sf):
    early = steps.early_rates(spark, sf)
    found = lookup.with_curves(steps.nearest_analogs(spark, sf), early)
    return spread(baseline.idw(found, BASINS.value("distance_power")), "p50_oil")


def _chosen(spark, sf):
    """Test wells' analogs scored by nearness, cut to twenty and warped."""
    found = forecast.nearest_first(_evaluation_pairs(spark, sf))
    cut = select.best(found.drop("analog_rank"), 20)
    return forecast.warped(lookup.with_curves(cut, steps.early_rates(spark, sf)))


@query
def warped_curves(spark, sf):
    return spread(
        _chosen(spark, sf).select("target_id", "candidate_id", "warped_oil"), "warped_oil"
    )


@query
def warped_mean_forecast(spark, sf):
    return spread(forecast.ranked_mean(_chosen(spark, sf)), "p50_oil")


@query
def bootstrap_interval(spark, sf):
    return spread(forecast.bootstrap(_chosen(spark, sf)), "p10_oil", "p90_oil")


def _request_analogs(spark, sf):
    return forecast.select_for_requests(
        bindings.forecast_requests(spark, sf),
        steps.early_rates(spark, sf),
        BASINS,
        as_of_year=bindings.AS_OF_YEAR,
    )


@query
def softmax_forecast(spark, sf):
    return spread(
        forecast.softmax(_request_analogs(spark, sf)), "p10_oil", "p50_oil", "p90_oil"
    )


@query
def analog_details(spark, sf):
    """The listed analogs of each request, one row per analog."""
    listed = forecast.details(_request_analogs(spark, sf))
    return listed.select(
        "target_id",
        F.col("avg_distance_mi").alias("mean_distance_mi"),
        "formation_match_pct",
        "avg_vintage_gap",
        F.inline("analogs"),
    )


def _batch(spark, sf):
    return forecast.batch(
        bindings.forecast_requests(spark, sf),
        steps.early_rates(spark, sf),
        BASINS,
        as_of_year=bindings.AS_OF_YEAR,
    )


@query
def batch_forecast(spark, sf):
    return _batch(spark, sf).select(
        "well_id",
        "formation",
        "proppant_per_ft",
        "fluid_per_ft",
        "error",
        "n_analogs",
        "p10_cum_9mo",
        "p50_cum_9mo",
        "p90_cum_9mo",
        "avg_distance_mi",
    )


@query
def batch_forecast_trained(spark, sf):
    """The batch with analogs chosen by the trained models, on the dense fields."""
    requests = bindings.drawn_together(bindings.forecast_requests(spark, sf))
    made = forecast.batch(
        requests,
        steps.early_rates(spark, sf, dense=True),
        BASINS,
        steps.rank_scorer(spark, sf),
        as_of_year=bindings.AS_OF_YEAR,
    )
    return made.select(
        "well_id", "error", "n_analogs", "p10_cum_9mo", "p50_cum_9mo", "p90_cum_9mo", "avg_distance_mi"
    )


@query
def forecast_long_export(spark, sf):
    return files.forecast_long(_batch(spark, sf))


@query
def forecast_summary(spark, sf):
    return forecast.summary(_batch(spark, sf))


# Evaluation -------------------------------------------------------------------------------


@query
def test_wells(spark, sf):
    return spread(steps.test_wells(spark, sf), "oil", "gas")


@query
def weighted_mae(spark, sf):
    return steps.baseline_scores(steps.early_rates(spark, sf)).select(
        "target_id", "basin_name", "n_analogs", "weighted_mae"
    )


@query
def error_stats(spark, sf):
    return evaluate.error_stats(steps.stored_scores(spark, sf))


@query
def outcome_counts(spark, sf):
    early = steps.early_rates(spark, sf)
    return evaluate.outcome_counts(early, steps.baseline_forecast(early), "basin_name")


def _back_test(spark, sf, chosen=_chosen, name="back_test", dense=False):
    """Stored forecasts and errors of the baseline and of the `chosen` analogs on the test wells."""

    def build():
        tests = steps.test_wells(spark, sf, dense)
        early = steps.early_rates(spark, sf, dense)
        found = lookup.with_curves(lookup.analogs(tests, early, BASINS), early)
        models = {
            "baseline": baseline.median(found),
            "ranked": forecast.ranked_mean(chosen(spark, sf)),
        }
        scored = [
            evaluate.score(made, tests).select(
                F.lit(name).alias("model"), "target_id", "basin_name", "p50_oil", "weighted_mae"
            )
            for name, made in models.items()
        ]
        return scored[0].unionByName(scored[1])

    table = steps.Steps.of(spark, sf).table(name, build, "model")
    return [table.filter(F.col("model") == m).drop("model") for m in ("baseline", "ranked")]


def _comparison(plain, ranked):
    return evaluate.compare(evaluate.error_stats(plain), evaluate.error_stats(ranked))


@query
def model_compare(spark, sf):
    return _comparison(*_back_test(spark, sf))


def _hybrid(plain, ranked):
    choice = _comparison(plain, ranked).select("basin_name", "winner").distinct()
    return spread(forecast.hybrid(plain, ranked, choice), "p50_oil")


@query
def hybrid_choice(spark, sf):
    return _hybrid(*_back_test(spark, sf))


def _trained_back_test(spark, sf):
    return _back_test(spark, sf, _model_chosen, "back_test_trained", dense=True)


@query
def model_compare_trained(spark, sf):
    """The baseline against the trained models; `model_compare` ranks by nearness instead."""
    return _comparison(*_trained_back_test(spark, sf))


@query
def hybrid_choice_trained(spark, sf):
    return _hybrid(*_trained_back_test(spark, sf))
