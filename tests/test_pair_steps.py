"""Steps on pairs exchange and sort no pairs for what few wells or folders say."""

from wellkin.operators import candidates
from wellkin.plans import stored


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_wells_travel_to_the_pairs(spark, monkeypatch):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", None)], "target_id string, candidate_id string")
    wells = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "well_id string, peak_oil double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = candidates.with_optional(pairs, wells, "candidate", ["peak_oil"])
        monkeypatch.setattr(candidates, "FEW_WELLS", 2)
        many = candidates.with_optional(pairs, wells, "candidate", ["peak_oil"])
        assert "SortMergeJoin" in _plan(many) and "SortMergeJoin" not in _plan(few)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_table_by_folders_is_written_unsorted(spark):
    rows = spark.range(40).selectExpr("id", "IF(id % 2 = 0, 'a', 'b') AS basin_name").coalesce(1)
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting, None)
    with stored._unsorted(spark):
        assert spark.conf.get(setting) == str(stored.OPEN_FOLDERS)
    made = stored.store(rows, "folders", "basin_name")
    assert spark.conf.get(setting, None) == before
    assert made.groupBy("basin_name").count().count() == 2 and made.count() == 40
