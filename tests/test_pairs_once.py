"""Queries that read the candidate pairs once take them as they are formed."""

import pytest

from wellkin.plans import steps
from wellkin.plans.catalog import QUERIES
from wellkin.plans.stored import Steps

DATA = "/root/testdata/sf0.001"
ONCE = ["operator_diverse_topk", "distance_bucket_onehot", "training_targets", "training_pairs", "group_sizes"]


@pytest.mark.parametrize("name", ONCE)
def test_pairs_are_not_written_and_rows_are_those_of_the_stored_table(spark, name):
    key = (spark.sparkContext.applicationId, DATA)
    before = Steps._made.pop(key, None)
    try:
        formed = sorted(map(tuple, QUERIES[name](spark, DATA).collect()), key=repr)
        assert Steps.of(spark, DATA).table_if_made("analog_candidates") is None
        stored = steps.candidates(spark, DATA)
        assert steps.candidates_once(spark, DATA) is stored
        assert formed == sorted(map(tuple, QUERIES[name](spark, DATA).collect()), key=repr)
        assert len(formed) > 1
    finally:
        Steps._made.pop(key, None)
        if before is not None:
            Steps._made[key] = before
