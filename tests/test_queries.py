"""The registered queries against their SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference
from checks.oracle import ORACLE
from wellkin.plans.catalog import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKED = [
    "basin_filter_label", "legacy_well_clean", "rig_clean", "formation_match_score",
    "completion_validity", "peak_aligned", "early_rates_scalar", "early_rates_long",
    "candidate_measures", "spacing_at_start", "knn_lookup", "newwell_lookup",
    "validate_suite", "validate_broken", "volume_summary", "first_date_coverage",
    "upsert_partial", "partition_replace", "peak_features", "wide_pair_features",
    "ranking_features_17", "graded_labels", "embedding_cosine", "baseline_batch",
    "batch_forecast", "weighted_mae", "error_stats",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)
    unchecked = set(QUERIES) - set(ORACLE)
    assert unchecked == {
        "lambdarank_scores", "lambdarank_forecast", "lambdarank_metrics", "feature_importance",
        "model_compare_trained", "hybrid_choice_trained", "batch_forecast_trained",
    }


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["target_id", "basin_name", "n_analogs", "weighted_mae"]
    assert df.count() == 4
