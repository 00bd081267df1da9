import datetime as dt
import json

import pytest
from frames import early, rows, well
from pyspark.sql import functions as F

from wellkin.operators import candidates, forecast, labels
from wellkin.params import BASINS
from wellkin.plans.stored import shared_folder, store
from wellkin.sources import files, merge, schemas, versions


def table(spark, data):
    return spark.createDataFrame(data, "k string, a int, b int, basin_name string")


def test_upsert_replaces_only_listed_columns(spark):
    old = table(spark, [("x", 1, 1, "p"), ("y", 2, 2, "p")])
    new = table(spark, [("y", None, 20, "q"), ("z", 3, 30, "q")])
    got = rows(merge.upsert(old, new, ["k"], ["a", "basin_name"]))
    assert got == [("x", 1, 1, "p"), ("y", None, 2, "q"), ("z", 3, 30, "q")]


def test_update_from_keeps_unmatched_rows(spark):
    base = table(spark, [("x", 1, 1, "p"), ("y", 2, 2, "p")])
    side = spark.createDataFrame([("y", 9)], "k string, a int")
    assert rows(merge.update_from(base, side, ["k"], ["a"]), "k", "a", "b") == [("x", 1, 1), ("y", 9, 2)]


def test_partition_replacement_leaves_other_basins(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(table(spark, [("x", 1, 1, "p"), ("y", 2, 2, "q")]), path, "basin_name")
    merge.replace_partition(table(spark, [("z", 3, 3, "q")]), path)
    assert rows(spark.read.parquet(path), "k", "basin_name") == [("x", "p"), ("z", "q")]


def test_parquet_is_read_recursively_with_a_schema(spark, tmp_path):
    frame = spark.createDataFrame(
        [("w", dt.date(2020, 1, 1), 1.0)],
        "state_well_id string, production_date date, production_quantity double",
    )
    for part in ("a", "b/c"):
        frame.write.parquet(str(tmp_path / part))
    got = files.read_parquet(spark, str(tmp_path), schemas.PRODUCTION_FEED)
    assert got.count() == 2 and got.columns == frame.columns


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="production_quantity"):
        schemas.require(spark.range(1), schemas.PRODUCTION_FEED)
    renamed = schemas.rename(spark.range(1), {"id": "well_id", "absent": "x"})
    assert renamed.columns == ["well_id"]


def test_requests_get_defaults_and_names(spark, tmp_path):
    path = tmp_path / "requests.json"
    path.write_text(json.dumps([{"lat": 40.0, "lon": -104.0, "formation": "Codell", "lateral_length": 9000},
                                {"well_id": "b", "proppant_per_ft": 1.0, "planned_date": "2024-05-01"}]))
    got = {r.lateral_length: r for r in files.read_requests(spark, str(path), multi_line=True).collect()}
    assert (got[9000.0].proppant_per_ft, got[9000.0].fluid_per_ft) == (2000.0, 50.0)
    assert got[9000.0].well_id.startswith("well_")
    assert (got[None].well_id, got[None].proppant_per_ft) == ("b", 1.0)
    assert got[None].planned_date == dt.date(2024, 5, 1)


def test_forecast_exports(spark, tmp_path):
    known = early(spark, *[well(f"05{i}", lat=40.3 + i / 200) for i in range(4)])
    requests = spark.createDataFrame(
        [("near", 40.3, -104.5, "NIOBRARA", 10000.0, 1500.0, 50.0, "A", None),
         ("far", 45.0, -90.0, "NIOBRARA", 10000.0, 1500.0, 50.0, None, None)],
        schemas.FORECAST_REQUESTS,
    )
    made = forecast.batch(requests, known, BASINS, as_of_year=2020)
    files.write_forecast_json(made, str(tmp_path / "json"))
    back = {r.well_id: r for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert back["far"].error and len(back["near"].forecast.p50_oil) == 9
    assert back["near"].input.lateral_length == 10000.0
    files.write_forecast_csv(made, str(tmp_path / "csv"))
    lines = spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True)
    assert rows(lines, "well_id", "month") == [("near", m) for m in range(1, 10)]


def test_training_matrix_is_written_twice(spark, tmp_path):
    known = early(spark, well("05a", first="2019-01-01"), well("05b", first="2020-01-01"))
    peaks = spark.createDataFrame(
        [], "well_id string, peak_oil double, peak_gas double, peak_oil_month int, oil_decline_rate double"
    )
    pairs = labels.pair_score(
        candidates.training_pairs(candidates.build(known, BASINS), known, peaks)
    )
    files.write_training(pairs, str(tmp_path), ["distance_mi", "length_ratio"], "analog_score")
    matrix = spark.read.parquet(str(tmp_path / "matrix"))
    assert matrix.columns == ["target_id", "candidate_id", "distance_mi", "length_ratio", "analog_score"]
    assert spark.read.parquet(str(tmp_path / "full")).count() == matrix.count() == 1


def test_stored_tables_live_in_the_configured_folder(spark):
    folder = shared_folder(spark)
    kept = store(spark.range(5).withColumn("p", F.col("id") % 2), "demo", "p")
    assert kept.count() == 5
    assert all(folder.split(":")[-1] in f for f in kept.inputFiles())


def test_a_published_basin_is_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, path)
    versions.publish(table(spark, [("x", 1, 1, "p"), ("y", 2, 2, "q"), ("n", 0, 0, None)]), path)
    versions.publish(table(spark, [("z", 3, 3, "q"), ("w", 4, 4, "r s/=")]), path)
    got = versions.read(spark, path)
    assert got.columns == ["k", "a", "b", "basin_name"]
    assert rows(got, "k", "basin_name") == [("n", None), ("w", "r s/="), ("x", "p"), ("z", "q")]
    versions.publish(table(spark, [("m", 5, 5, None)]), path)
    assert rows(versions.read(spark, path), "k") == ["m", "w", "x", "z"]
    versions.publish(table(spark, []), path)
    assert rows(versions.read(spark, path), "k") == ["m", "w", "x", "z"]


def test_a_failure_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.publish(table(spark, [("x", 1, 1, "p"), ("y", 2, 2, "q")]), path)
    before = versions.read(spark, path)
    want = rows(before)

    def fails(*_):
        raise OSError("lost between write and switch")

    monkeypatch.setattr(versions, "_commit", fails)
    with pytest.raises(OSError, match="lost"):
        versions.publish(table(spark, [("z", 9, 9, "q")]), path)
    assert rows(versions.read(spark, path)) == want
    broken = table(spark, [("z", 9, 9, "q")]).withColumn("a", F.raise_error(F.lit("stop")).cast("int"))
    monkeypatch.undo()
    with pytest.raises(Exception, match="stop"):
        versions.publish(broken, path)
    assert rows(versions.read(spark, path)) == want
    # A reader that started before a switch keeps reading the version it saw.
    versions.publish(table(spark, [("z", 9, 9, "q")]), path)
    assert rows(before) == want and ("z", 9, 9, "q") in rows(versions.read(spark, path))


def test_a_published_upsert_moves_rows_between_basins(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.publish(table(spark, [("x", 1, 1, "p"), ("y", 2, 2, "q"), ("u", 7, 7, "s")]), path)
    new = table(spark, [("y", None, 20, "p"), ("z", 3, 30, "r")])
    versions.publish_upsert(new, path, ["k"], ["a", "basin_name"])
    want = [("u", 7, 7, "s"), ("x", 1, 1, "p"), ("y", None, 2, "p"), ("z", 3, 30, "r")]
    assert rows(versions.read(spark, path)) == want
