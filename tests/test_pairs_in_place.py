"""Pairs are ranked where the join left them, and meet no exchange for what the wells say."""

import pytest
from pyspark.sql import functions as F

from tests.test_pairs import points, sides
from wellkin.operators import candidates, radius
from wellkin.params import BASINS
from wellkin.plans import steps
from wellkin.plans.catalog import QUERIES
from wellkin.plans.stored import Steps

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _unbroadcast(spark, made):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _plan(made())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_nearest_search_exchanges_and_keeps_no_pairs(spark, monkeypatch):
    _, df = points(spark, 400, 21, ((40.0, 40.1), (-104.6, -104.5)))
    t, c = sides(df)
    kept, checkpoint = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a: kept.append(self.columns) or checkpoint(self, *a))
    plan = _unbroadcast(spark, lambda: radius.nearest_within(t, c, 15.0, 5))
    assert len(kept) > 2 and not any("distance_mi" in columns or "analog_rank" in columns for columns in kept)
    # What stands above a radius join: the rank is taken in its own partitions.
    above = plan.split("SortMergeJoin")[0]
    assert "Window" in above and "Exchange hashpartitioning" not in above
    found = radius.nearest_within(t, c, 15.0, 5)
    whole = radius.top_by_distance(radius.within_radius(t, c, 15.0), 5)
    columns = ("target_id", "candidate_id", "analog_rank")
    assert sorted(found.select(*columns).collect()) == sorted(whole.select(*columns).collect())


@pytest.mark.parametrize("whole", [False, True])
def test_blocks_follow_the_measured_work(spark, monkeypatch, whole):
    _, df = points(spark, 300, 5, ((40.0, 40.02), (-104.52, -104.5)))
    t, c = sides(df)
    one = radius.within_radius(t, c, 5.0, cells=True, whole_targets=whole)
    monkeypatch.setattr(radius, "LEAST_PAIRS", 100)
    many = radius.within_radius(t, c, 5.0, cells=True, whole_targets=whole)
    ids = ("target_id", "candidate_id")
    assert sorted(one.select(*ids).collect()) == sorted(many.select(*ids).collect())
    assert one.select(*radius.CELL).distinct().count() < 9 < many.select(*radius.CELL).distinct().count()
    places = many.groupBy("target_id").agg(F.countDistinct("_tpart", "_cpart").alias("n")).agg(F.max("n")).first()[0]
    assert (places == 1) is whole


def test_spacing_joins_the_wells_and_not_their_pairs(spark, monkeypatch):
    early = steps.early_rates(spark, "/root/testdata/sf0.01")
    near = early.select("well_id", *[F.lit(v).alias(k) for k, v in candidates.SPACING_DEFAULTS.items()])
    near = near.withColumn("wells_within_1mi_at_start", F.length("well_id")).limit(40)
    twice = near.unionByName(near.limit(3)).localCheckpoint()
    monkeypatch.setattr(candidates, "FEW_WELLS", 0)
    basins = BASINS.override(min_vintage_year=1995)
    plan = _unbroadcast(spark, lambda: candidates.build(early, basins, twice))
    # The pair join is the outermost join: no pair is exchanged for the wells' columns.
    assert "_band" in plan[plan.index("Join") :].split("\n")[0]
    pairs = candidates.build(early, basins).drop(*candidates.SPACING_DEFAULTS)
    want = pairs.join(twice.withColumnRenamed("well_id", "candidate_id"), "candidate_id", "left").fillna(candidates.SPACING_DEFAULTS)
    got = candidates.build(early, basins, twice)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


ONCE = [
    "candidates_per_target", "candidate_top", "nearest_topk", "best_topk", "major_operator_flag", "graded_labels",
    "pair_score_labels", "training_matrix", "training_round_trip", "ranking_metrics",
]


def test_pairs_are_not_written_for_queries_that_read_them_once_or_twice(spark):
    key = (spark.sparkContext.applicationId, DATA)
    before = Steps._made.pop(key, None)
    try:
        formed = {name: sorted(map(str, QUERIES[name](spark, DATA).collect())) for name in ONCE}
        assert Steps.of(spark, DATA).table_if_made("analog_candidates") is None
        steps.candidates(spark, DATA)
        for name in ("best_topk", "graded_labels", "training_matrix"):
            assert formed[name] == sorted(map(str, QUERIES[name](spark, DATA).collect())), name
    finally:
        Steps._made.pop(key, None)
        if before is not None:
            Steps._made[key] = before
