import math

import numpy as np
import pytest
from frames import CURVE, early, rows, well
from pyspark.sql import functions as F

from wellkin.functions import series
from wellkin.functions.matching import formation_score
from wellkin.operators import embeddings, features, labels, peaks, percentiles, wells
from wellkin.params import BASINS, revenue_weights


def test_unknown_basin_raises_and_codes_are_aliases():
    assert BASINS.get("dj") is BASINS.get("dj_basin")
    with pytest.raises(KeyError):
        BASINS.get("permian")


def test_parameter_table_has_one_row_per_basin(spark):
    got = rows(BASINS.table(spark), "name", "max_distance_miles", "peak_month_window")
    assert got == [("bakken", 20.0, 6), ("dj_basin", 15.0, 7)]


@pytest.mark.parametrize(
    "ours, target, score",
    [("NIOBRARA", "Niobrara", 1.0), ("Niobrara B", "Niobrara A", 0.8), ("Codell", "Niobrara A", 0.0),
     ("Upper three forks", "Three Forks 1st", 0.8), (None, "Codell", 0.0)],
)
def test_formation_score(spark, ours, target, score):
    frame = spark.createDataFrame([(ours, target)], "a string, b string")
    assert rows(frame.select(formation_score(F.col("a"), F.col("b")))) == [score]


def test_per_foot_is_null_without_a_lateral(spark):
    frame = spark.createDataFrame(
        [(100, 10), (100, 0), (100, None)], "proppant_lbs int, lateral_length int"
    )
    assert rows(frame.select(wells.per_foot("proppant_lbs"))) == [10.0, None, None]


def test_peak_features(spark):
    flat = [5.0, 9.0, 9.0, 4.0, 3.0, 2.0, 1.0, 1.0, 3.0]
    row = peaks.features(early(spark, well("05a", oil=flat, gas=[0.0] * 9, ppf=8.0, lateral=2000.0))).first()
    assert (row.peak_oil, row.peak_oil_month) == (9.0, 2)
    assert row.peak_oil_per_kft == 4.5 and row.peak_oil_per_ppf == 1.0
    assert row.oil_decline_rate == pytest.approx(0.6)
    assert (row.peak_gas, row.peak_gas_month, row.gas_decline_rate) == (0.0, 1, 0.0)


@pytest.mark.parametrize(
    "distance, bucket",
    [(0.0, None), (0.5, "0-1mi"), (1.0, "0-1mi"), (3.0, "1-3mi"), (15.0, "10-15mi"), (15.1, None)],
)
def test_distance_buckets_close_on_the_right(spark, distance, bucket):
    frame = spark.createDataFrame([(distance,)], "d double")
    assert rows(frame.select(features.distance_bucket(F.col("d")))) == [bucket]


def ranking_frame(spark, **changes):
    base = dict(
        target_id="t", candidate_id="c", distance_mi=3.0, length_ratio=1.2, delta_length=2000.0,
        ppf_ratio=0.05, same_operator=True, vintage_gap_years=2, target_lateral_length=10000.0,
        target_proppant_per_ft=1000.0, candidate_proppant_per_ft=50.0, target_peak_oil=99.0,
        candidate_peak_oil=200.0, target_oil_decline_rate=None, candidate_oil_decline_rate=0.9,
    ) | changes
    schema = (
        "target_id string, candidate_id string, distance_mi double, length_ratio double, delta_length double, "
        "ppf_ratio double, same_operator boolean, vintage_gap_years int, target_lateral_length double, "
        "target_proppant_per_ft double, candidate_proppant_per_ft double, target_peak_oil double, "
        "candidate_peak_oil double, target_oil_decline_rate double, candidate_oil_decline_rate double"
    )
    return spark.createDataFrame([tuple(base.values())], schema)


def test_ranking_vector(spark):
    row = features.ranking17(ranking_frame(spark)).first()
    assert list(row.asDict())[2:] == list(features.RANKING_FEATURES)
    assert row.log_ppf_ratio == pytest.approx(math.log(0.1)) and row.ppf_ratio == 0.05
    assert row.peak_oil_ratio == 2.0 and row.log_peak_oil_ratio == pytest.approx(math.log(2))
    assert row.decline_rate_diff == pytest.approx(0.2)
    assert row.distance_to_nearest_at_start == 999.0


def test_ranking_vector_defaults(spark):
    row = features.ranking17(
        ranking_frame(
            spark, target_lateral_length=0.0, target_proppant_per_ft=0.0, target_peak_oil=None,
            candidate_peak_oil=None, same_operator=None, vintage_gap_years=None,
        )
    ).first()
    assert (row.length_delta, row.log_length_ratio, row.ppf_ratio, row.log_ppf_ratio) == (0, 0, 1, 0)
    assert (row.candidate_peak_oil, row.peak_oil_ratio, row.log_peak_oil_ratio) == (0, 1, 0)
    assert (row.same_operator, row.vintage_gap_years) == (0, 0)
    bare = features.ranking17(ranking_frame(spark).drop("ppf_ratio"), with_peaks=False).first()
    assert bare.ppf_ratio == pytest.approx(1000 / 51) and bare.peak_oil_ratio == 1.0


def label_frame(spark, curves, target=CURVE):
    data = [("t", f"c{i:02d}", target, list(c), 1.0, 1000.0, 999.0) for i, c in enumerate(curves)]
    return spark.createDataFrame(
        data,
        "target_id string, candidate_id string, target_oil array<double>, candidate_oil array<double>, "
        "length_ratio double, target_proppant_per_ft double, candidate_proppant_per_ft double",
    )


def test_graded_labels_match_numpy(spark):
    rng = np.random.default_rng(1)
    curves = [[v + rng.normal(0, 20) for v in CURVE] for _ in range(37)]
    w = np.array(revenue_weights())
    errors = np.array([np.sum(w * np.abs(np.array(CURVE) - c)) / w.sum() for c in curves])
    a, b, c = np.percentile(errors, [10, 30, 60])
    want = [3 if e <= a else 2 if e <= b else 1 if e <= c else 0 for e in errors]
    got = rows(labels.graded(label_frame(spark, curves)), "candidate_id", "label")
    assert [g[1] for g in got] == want


def test_equal_errors_are_all_excellent(spark):
    assert set(rows(labels.graded(label_frame(spark, [CURVE] * 5)), "label")) == {3}


def test_pair_score_of_a_missing_curve_is_the_worst(spark):
    frame = label_frame(spark, [CURVE]).withColumn("candidate_oil", F.lit(None).cast("array<double>"))
    row = labels.pair_score(frame).first()
    assert (row.production_error, row.is_good_analog) == (1.0, 0)
    assert labels.pair_score(label_frame(spark, [CURVE])).first().analog_score == 1.0


def test_split_is_by_target_order(spark):
    data = [(f"{p}{i:03d}", f"c{j}") for p in ("05", "33") for i in range(10) for j in range(3)]
    frame = spark.createDataFrame(data, "target_id string, candidate_id string")
    got = labels.split(frame).select("target_id", "split").distinct()
    train = sorted(r.target_id for r in got.collect() if r.split == "train")
    assert train == sorted({d[0] for d in data})[:16]


def test_embeddings_match_an_eigen_decomposition(spark, tmp_path):
    rng = np.random.default_rng(2)
    curves = np.abs(rng.normal(100, 40, (60, 9))) * np.linspace(2, 0.5, 9) * rng.uniform(0.5, 2, (60, 1))
    curves[:4, :3] = 0.0
    frame = early(
        spark,
        *[well(f"05{i:03d}", oil=c.tolist(), gas=(curves[(i * 7 + 5) % 60] * 3).tolist()) for i, c in enumerate(curves)],
    )
    oil = embeddings.prepared(frame, "oil")
    assert oil.count() == 56
    model = embeddings.fit(oil)
    logs = np.log1p(curves[4:])
    scaled = (logs - logs.mean(0)) / logs.std(0)
    values, vectors = np.linalg.eigh(np.cov(scaled.T))
    order = np.argsort(values)[::-1][:4]
    assert model.explained == pytest.approx(values[order] / values.sum(), abs=1e-8)
    scores = scaled @ vectors[:, order]
    got = np.array([r.embedding for r in model.transform(oil).orderBy("well_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(scores), abs=1e-6)

    model.write(str(tmp_path / "curves"), spark)
    again = embeddings.CurveModel.read(str(tmp_path / "curves"), spark)
    assert (again.count, again.signs, again.scale) == (model.count, model.signs, model.scale)
    assert again.transform(oil).exceptAll(model.transform(oil)).count() == 0

    both = embeddings.fit_transform(frame)
    assert both.count() == 56 and both.filter("gas_embedding IS NULL").count() == 4
    summary = embeddings.summary(both)
    assert summary.count() == 8
    months = embeddings.top_months(model.loadings(spark))
    first = np.abs(vectors[:, order[0]])
    assert [r.month for r in months.collect()] == (np.argsort(first)[::-1][:3] + 1).tolist()


@pytest.mark.parametrize("few, parts", [(200_000, 64), (50, 64), (3, 5)])
def test_exact_percentiles_match_numpy(spark, few, parts):
    rng = np.random.default_rng(4)
    groups = {
        "wide": rng.lognormal(3, 2, 150_000),
        "ties": rng.integers(0, 4, 140_000).astype(float),
        "few": np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]),
        "one": np.array([7.0]),
    }
    import pandas as pd

    frame = spark.createDataFrame(
        pd.concat(pd.DataFrame({"g": k, "v": v}) for k, v in groups.items())
    )
    ranks = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0}
    for row in percentiles.exact(frame, ["g"], "v", ranks, few, parts).collect():
        want = np.percentile(groups[row.g], [10, 50, 90, 100])
        assert [row.a, row.b, row.c, row.d] == pytest.approx(want, rel=1e-12)


def test_a_sketch_that_misses_the_rank_does_no_harm(spark, monkeypatch):
    data = [float(i) for i in range(200)]
    frame = spark.createDataFrame([(None, v) for v in data], "g string, v double")
    # Cuts that all lie above the wanted ranks, as no sound sketch would give them.
    monkeypatch.setattr(
        percentiles.F, "percentile_approx", lambda c, *_: F.array(F.max(c), F.max(c) - 0.5)
    )
    row = percentiles.exact(frame, ["g"], "v", {"a": 0.25, "b": 0.9}, few=199).first()
    assert (row.g, row.a, row.b) == (None, *[pytest.approx(np.quantile(data, q)) for q in (0.25, 0.9)])


def test_positions_spread_ids_that_share_a_prefix(spark):
    ids = [f"05000000{i:05d}" for i in range(3000)]
    made = labels._positions(spark.createDataFrame([(i,) for i in ids], "target_id string")).cache()
    assert [r.target_id for r in made.orderBy("_position").collect()] == ids
    assert [r._position for r in made.orderBy("target_id").collect()] == list(range(1, 3001))
    assert {r._total for r in made.collect()} == {3000}


def test_cosine_of_missing_is_zero_and_in_range(spark):
    frame = spark.createDataFrame(
        [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0, 1.0])],
        "a array<double>, b array<double>",
    )
    got = [r[0] for r in frame.select(series.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, -1.0, 0.0], abs=1e-6)
