import math
import random

import pytest
from frames import early, rows, well
from pyspark.sql import functions as F

from wellkin.operators import candidates, lookup, radius, select, spacing
from wellkin.params import BASINS

# Fixed values of the spheroid, for an independent iterative distance.
A, FLAT = 6378137.0, 1 / 298.257223563


def geodesic_miles(lat1, lon1, lat2, lon2):
    """Vincenty's inverse formula."""
    if (lat1, lon1) == (lat2, lon2):
        return 0.0
    b = A * (1 - FLAT)
    u1, u2 = (math.atan((1 - FLAT) * math.tan(math.radians(x))) for x in (lat1, lat2))
    gap = lam = math.radians(lon2 - lon1)
    for _ in range(100):
        sin_s = math.hypot(
            math.cos(u2) * math.sin(lam),
            math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam),
        )
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2_a = 1 - sin_a**2
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2_a if cos2_a else 0.0
        c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
        new = gap + (1 - c) * FLAT * sin_a * (
            s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1))
        )
        if abs(new - lam) < 1e-13:
            break
        lam = new
    uu = cos2_a * (A * A - b * b) / (b * b)
    big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
    big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
    ds = big_b * sin_s * (
        mid
        + big_b / 4
        * (cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3))
    )
    return b * big_a * (s - ds) / 1609.34


def points(spark, n, seed, box=((39.6, 40.4), (-104.9, -103.9)), prefix="w"):
    rng = random.Random(seed)
    data = [
        (f"{prefix}{i:04d}", "dj_basin", rng.uniform(*box[0]), rng.uniform(*box[1]))
        for i in range(n)
    ]
    return data, spark.createDataFrame(
        data, "well_id string, basin_name string, lat double, lon double"
    )


def sides(df):
    keep = ("basin_name",)
    return radius.prefixed(df, "target_", keep), radius.prefixed(df, "candidate_", keep)


def brute(data, miles, other=None):
    return sorted(
        (a[0], b[0])
        for a in data
        for b in (other or data)
        if geodesic_miles(a[2], a[3], b[2], b[3]) <= miles
    )


def test_distance_matches_the_geodesic(spark):
    data, df = points(spark, 60, 1)
    got = radius.within_radius(*sides(df), 200.0).select("target_id", "candidate_id", "distance_mi")
    where = {d[0]: d for d in data}
    for t, c, d in got.collect():
        assert d == pytest.approx(geodesic_miles(*where[t][2:], *where[c][2:]), abs=0.001)


@pytest.mark.parametrize("miles", [1.0, 7.0, 15.0])
def test_cells_find_every_pair_once(spark, miles):
    data, df = points(spark, 200, 2)
    got = rows(radius.within_radius(*sides(df), miles), "target_id", "candidate_id")
    assert got == brute(data, miles)


def test_cells_near_the_equator_and_far_north(spark):
    for seed, box in ((3, ((-0.5, 0.5), (10.0, 11.0))), (4, ((69.5, 70.5), (-150.0, -148.0)))):
        data, df = points(spark, 120, seed, box)
        got = rows(radius.within_radius(*sides(df), 12.0), "target_id", "candidate_id")
        assert got == brute(data, 12.0)


def test_hot_cells_are_split_without_losing_or_repeating_pairs(spark):
    data, df = points(spark, 150, 5, ((40.0, 40.05), (-104.5, -104.45)))
    plain = rows(radius.within_radius(*sides(df), 2.0), "target_id", "candidate_id")
    split = radius.within_radius(*sides(df), 2.0, pairs_per_task=200)
    assert rows(split, "target_id", "candidate_id") == plain == brute(data, 2.0)


RULES = ["target_id <> candidate_id", "candidate_id LIKE '%7' AND target_id <> candidate_id"]


@pytest.mark.parametrize("rule, k", [(RULES[0], 6), (RULES[1], 2)])
def test_rings_find_what_the_whole_radius_holds(spark, rule, k):
    data, df = points(spark, 150, 6)
    clump, dense = points(spark, 60, 7, ((40.1, 40.12), (-104.4, -104.38)), "z")
    both = sides(df.unionByName(dense))
    columns = ("target_id", "analog_rank", "candidate_id")
    whole = radius.top_by_distance(radius.within_radius(*both, 15.0, where=rule), k)
    assert rows(radius.nearest_within(*both, 15.0, k, where=rule), *columns) == rows(whole, *columns)


def test_ring_pairs_follow_k_and_not_the_density(spark):
    k, formed = 5, []
    for n in (300, 1200):
        data, df = points(spark, n, 11, ((40.0, 40.2), (-104.7, -104.5)))
        t, c = sides(df)
        started = radius.ring_starts(t, c, 15.0, k).cache()
        assert started.count() == n and started.filter("_ring = 0").count() == 0
        pairs = 0
        for r in started.select("_ring").distinct().collect():
            own = started.filter(F.col("_ring") == r._ring).drop("_ring")
            pairs += radius.within_radius(own, c, 15.0 / (1 << r._ring)).count()
        formed.append(pairs / n)
        whole = radius.top_by_distance(radius.within_radius(t, c, 15.0), k)
        got = radius.nearest_within(t, c, 15.0, k)
        assert rows(got, "target_id", "candidate_id") == rows(whole, "target_id", "candidate_id")
    assert max(formed) < 20 * k and formed[1] < 1.5 * formed[0]


def test_lookups_of_every_kind_search_rings(spark, monkeypatch):
    rng = random.Random(12)
    wells = [
        well(
            f"05{i:03d}", operator=rng.choice("AB"), formation=rng.choice(["X", "Y", None]),
            lat=40 + rng.random() * 0.1, lon=-104.5 + rng.random() * 0.1,
            first=f"20{rng.randint(18, 22)}-0{rng.randint(1, 9)}-01",
            lateral=rng.choice([8000.0, 10000.0, 11000.0, None]),
        )
        for i in range(120)
    ]
    frame = early(spark, *wells)
    requests = frame.selectExpr(
        "well_id", "lat", "lon", "formation", "lateral_length", "proppant_per_ft", "fluid_per_ft",
        "operator_name AS operator", "IF(well_id > '05060', date'2020-06-01', NULL) AS planned_date",
    )
    def found():
        return [
            rows(made, "target_id", "analog_rank", "candidate_id")
            for made in (
                lookup.analogs(frame, frame, BASINS, 4),
                lookup.new_well(requests, frame, k=9),
                lookup.evaluation(frame, frame, k=6),
            )
        ]
    rings = found()
    monkeypatch.setattr(radius, "ring_starts", lambda t, *_: t.withColumn("_ring", F.lit(0)))
    assert rings == found() and all(len(r) > 100 for r in rings)


def pair_rows(spark, *wells, columns=("target_id", "candidate_id")):
    return rows(candidates.match(early(spark, *wells), BASINS), *columns)


def test_candidate_lateral_limits_are_inclusive(spark):
    got = pair_rows(
        spark,
        well("05t", first="2020-01-01", lateral=10000.0),
        well("05low", lateral=8000.0),
        well("05high", lateral=12000.0),
        well("05under", lateral=7999.0),
        well("05over", lateral=12001.0),
    )
    assert {c for t, c in got if t == "05t"} == {"05low", "05high"}


def test_candidates_may_share_the_date_but_lookups_are_strict(spark):
    both = (well("05a"), well("05b"))
    assert pair_rows(spark, *both) == [("05a", "05b"), ("05b", "05a")]
    frame = early(spark, *both)
    assert lookup.analogs(frame, frame, BASINS).count() == 0


def test_candidates_respect_prefix_basin_vintage_and_zero_months(spark):
    got = pair_rows(
        spark,
        well("05t", first="2020-01-01"),
        well("99x"),
        well("05old", first="2017-12-31"),
        well("05dry", oil=[1.0] * 6 + [0.0] * 3),
        well("33b", basin="bakken"),
        well("05ok"),
    )
    assert {c for t, c in got if t == "05t"} == {"05ok"}


def test_same_place_has_distance_zero(spark):
    got = candidates.match(early(spark, well("05a"), well("05b")), BASINS)
    assert rows(got, "distance_mi") == [0.0, 0.0]


@pytest.mark.parametrize(
    "a, b, pool, lookups",
    [(None, None, True, 0), ("X", None, False, 0), ("x", "X", True, 0), ("X", "X", True, 1)],
)
def test_formation_match_rules(spark, a, b, pool, lookups):
    frame = early(
        spark, well("05t", formation=a, first="2020-01-01"), well("05c", formation=b)
    )
    pairs = candidates.measure(candidates.match(frame, BASINS))
    assert rows(pairs, "formation_match") == [pool]
    assert lookup.analogs(frame, frame, BASINS).count() == lookups


@pytest.mark.parametrize("a, b, same", [("A", "A", True), (None, None, False), ("A", None, False)])
def test_same_operator_needs_two_names(spark, a, b, same):
    frame = early(spark, well("05t", operator=a, first="2020-01-01"), well("05c", operator=b))
    assert rows(candidates.measure(candidates.match(frame, BASINS)), "same_operator") == [same]


def test_measures_are_candidate_over_target(spark):
    frame = early(
        spark,
        well("05t", first="2021-05-01", lateral=10000.0, ppf=1000.0, fpf=0.0),
        well("05c", first="2019-12-01", lateral=11000.0, ppf=1500.0),
    )
    row = candidates.measure(candidates.match(frame, BASINS)).first()
    assert row.length_ratio == pytest.approx(1.1) and row.delta_length == 1000.0
    assert row.ppf_ratio == pytest.approx(1.5) and row.fpf_ratio is None
    assert row.vintage_gap_years == 2


def test_spacing_counts_only_wells_that_existed(spark):
    step = 0.5 / 69.0
    frame = early(
        spark,
        well("05a", lat=40.0, first="2018-01-01"),
        well("05b", lat=40.0 + step, first="2019-01-01"),
        well("05c", lat=40.0 + 4 * step, first="2020-01-01"),
        well("05d", lat=40.0 + 16 * step, first="2020-01-01"),
        well("05far", lat=41.9, first="2018-01-01"),
    )
    got = {r.well_id: r for r in spacing.at_start(frame, BASINS).collect()}
    counts = {
        k: (r.wells_within_1mi_at_start, r.wells_within_3mi_at_start) for k, r in got.items()
    }
    assert counts == {
        "05a": (0, 0), "05b": (1, 1), "05c": (0, 2), "05d": (0, 0), "05far": (0, 0),
    }
    assert got["05a"].distance_to_nearest_at_start == 999.0
    assert got["05b"].distance_to_nearest_at_start == pytest.approx(0.5, abs=0.01)
    assert got["05b"].distance_to_second_nearest_at_start == 999.0
    assert got["05c"].distance_to_second_nearest_at_start == pytest.approx(2.0, abs=0.01)
    assert got["05d"].distance_to_nearest_at_start == pytest.approx(6.0, abs=0.05)


def test_spacing_equals_all_pairs_where_cells_are_split(spark, monkeypatch):
    data, df = points(spark, 150, 21, ((40.0, 40.4), (-104.9, -104.5)))
    rng = random.Random(22)
    days = {d[0]: f"20{rng.randint(18, 22)}-0{rng.randint(1, 9)}-01" for d in data}
    frame = early(spark, *[well(d[0], lat=d[2], lon=d[3], first=days[d[0]]) for d in data])
    got = {r.well_id: r for r in spacing.at_start(frame, BASINS).collect()}
    split = radius.within_radius
    monkeypatch.setattr(spacing, "within_radius", lambda *a, **k: split(*a, pairs_per_task=50, **k))
    assert {r.well_id: r for r in spacing.at_start(frame, BASINS).collect()} == got
    for d in data:
        near = sorted(
            geodesic_miles(d[2], d[3], o[2], o[3]) for o in data if o[0] != d[0] and days[o[0]] <= days[d[0]]
        )
        r = got[d[0]]
        assert r.wells_within_1mi_at_start == sum(x <= 1 for x in near)
        assert r.wells_within_3mi_at_start == sum(x <= 3 for x in near)
        want = [x for x in near if x <= 15][:2] + [999.0, 999.0]
        assert r.distance_to_nearest_at_start == pytest.approx(want[0], abs=0.001)
        assert r.distance_to_second_nearest_at_start == pytest.approx(want[1], abs=0.001)


def test_spacing_exchanges_no_pairs(spark):
    data, df = points(spark, 60, 23)
    pairs = radius.within_radius(*sides(df), 3.0, cells=True)
    plan = spacing.around(pairs, 1.0, ("basin_name",))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert above.count("Exchange") == 1 and "partial_collect_list" in above[above.index("Exchange") :]


def scored(spark, seed=8, targets=12, per_target=40):
    rng = random.Random(seed)
    data = [
        (f"t{t}", f"c{c:03d}", rng.choice(["A", "B", "C", None]), float(rng.randint(0, 9)), 1.0)
        for t in range(targets)
        for c in range(per_target)
    ]
    frame = spark.createDataFrame(
        data,
        "target_id string, candidate_id string, candidate_operator_name string, score double, "
        "distance_mi double",
    )
    return data, frame


def test_diverse_selection_equals_greedy(spark):
    data, frame = scored(spark)
    want = []
    for target in {d[0] for d in data}:
        taken, chosen = {}, 0
        for d in sorted((d for d in data if d[0] == target), key=lambda d: (-d[3], d[4], d[1])):
            if taken.get(d[2], 0) < 3 and chosen < 7:
                taken[d[2]] = taken.get(d[2], 0) + 1
                chosen += 1
                want.append((target, d[1]))
    assert rows(select.diverse(frame, 7, 3), "target_id", "candidate_id") == sorted(want)


def test_five_of_one_operator_keep_three_and_the_next_fills(spark):
    data = [("t", f"c{i}", "A", 10.0 - i, 1.0) for i in range(5)] + [("t", "c9", "B", 0.0, 1.0)]
    frame = spark.createDataFrame(data, scored(spark)[1].schema)
    assert rows(select.diverse(frame, 4, 3), "candidate_id") == ["c0", "c1", "c2", "c9"]


def test_top_category_flag(spark):
    data, frame = scored(spark)
    flagged = select.flag_top_categories(frame, "candidate_operator_name", 2)
    assert flagged.count() == len(data)
    assert flagged.filter("candidate_operator_name IS NULL AND is_major_operator = 1").count() == 0
    assert flagged.filter("is_major_operator = 1").select("candidate_operator_name").distinct().count() == 2


def test_training_pairs_limit_keeps_the_first_targets(spark):
    wells = [well(f"05{i}", first=f"20{18 + i}-01-01") for i in range(5)]
    frame = early(spark, *wells)
    pairs = candidates.build(frame, BASINS)
    peaks = spark.createDataFrame(
        [], "well_id string, peak_oil double, peak_gas double, peak_oil_month int, oil_decline_rate double"
    )
    got = candidates.training_pairs(pairs, frame, peaks, (2019, 2022), limit=2)
    assert {r.target_id for r in got.collect()} == {"051", "052"}
    assert got.filter(F.col("target_peak_oil").isNotNull()).count() == 0


def test_candidates_of_one_well_come_nearest_first(spark):
    frame = early(
        spark, well("05t", first="2020-01-01"), well("05far", lat=40.4), well("05near", lat=40.31)
    ).withColumns({c: F.lit(1.0) for c in ("avg_oil", "avg_gas", "cum_oil", "cum_gas")})
    got = candidates.of_well(candidates.build(frame, BASINS), frame, "05t", 5)
    assert [r.candidate_id for r in got.collect()] == ["05near", "05far"]
