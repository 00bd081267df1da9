import datetime as dt

import pytest
from frames import day, rows
from pyspark.sql import functions as F

from wellkin.operators import curves, production
from wellkin.params import BASINS


def monthly(spark, data):
    """(well, date, oil) triples; gas is ten times the oil."""
    return spark.createDataFrame(
        [(w, day(d), o, None if o is None else o * 10) for w, d, o in data],
        "well_id string, prod_date date, oil_bbls double, gas_mcf double",
    )


def months(well, oils, start=(2019, 1)):
    year, month = start
    out = []
    for i, oil in enumerate(oils):
        index = month - 1 + i
        out.append((well, dt.date(year + index // 12, index % 12 + 1, 1).isoformat(), oil))
    return out


def aligned(spark, data, window=7):
    return production.align(production.month_index(monthly(spark, data)), window)


def test_feeds_take_the_largest_value_not_the_sum(spark):
    feed = spark.createDataFrame(
        [("w", day("2019-01-01"), 10.0), ("w", day("2019-01-01"), 30.0), ("w", day("2013-12-31"), 5.0)],
        "state_well_id string, production_date date, production_quantity double",
    )
    union = production.union_feeds(feed, feed)
    assert union.columns == ["well_id", "prod_date", "oil_bbls", "gas_mcf"]
    assert rows(production.monthly_max(union)) == [("w", day("2019-01-01"), 30.0, 30.0)]


def test_repeated_ids_in_the_well_list_do_not_multiply_rows(spark):
    wells = spark.createDataFrame([("a",), ("a",)], "well_id string")
    data = monthly(spark, months("a", [1.0]) + months("b", [1.0]))
    assert rows(production.of_wells(data, wells), "well_id") == ["a"]


def test_history_gate_needs_nine_dates(spark):
    data = monthly(spark, months("eight", [1.0] * 8) + months("nine", [1.0] * 9))
    assert set(rows(production.history_gate(data), "well_id")) == {"nine"}


@pytest.mark.parametrize("later, index", [("2020-02-29", 1), ("2020-02-28", 0)])
def test_month_index_at_month_ends(spark, later, index):
    data = monthly(spark, [("w", "2020-01-31", 1.0), ("w", later, 1.0)])
    got = production.month_index(data).filter(F.col("prod_date") == later)
    assert rows(got, "month_index") == [index]


def test_equal_peaks_take_the_earlier_month(spark):
    data = months("w", [1.0, 2.0, 9.0, 3.0, 9.0, 1.0, 1.0, 1.0])
    indexed = production.month_index(monthly(spark, data))
    assert rows(production.peak_month(indexed)) == [("w", 2, 9.0)]


def test_peak_outside_the_window_is_ignored(spark):
    data = months("w", [1.0, 5.0, 2.0, 2.0, 2.0, 2.0, 2.0, 99.0])
    indexed = production.month_index(monthly(spark, data))
    assert rows(production.peak_month(indexed), "peak_month") == [1]
    assert rows(production.peak_month(indexed, 8), "peak_month") == [7]


def test_alignment_starts_at_the_peak_and_drops_wells_without_oil(spark):
    data = months("w", [1.0, 5.0, 2.0]) + months("dry", [0.0, None, 0.0])
    got = aligned(spark, data)
    assert rows(got, "well_id", "prod_month", "oil_bbls") == [("w", 0, 5.0), ("w", 1, 2.0)]


def headers(spark, *wells):
    data = [(w, "dj_basin", "A", "NIOBRARA", 40.0, -104.0, lateral, 15_000_000, 500_000.0) for w, lateral in wells]
    return spark.createDataFrame(
        data,
        "well_id string, basin_name string, operator string, formation string, lat double, lon double, "
        "lateral_length int, proppant_lbs bigint, fluid_gals double",
    )


def test_early_curves_accept_and_reject(spark):
    nine = [9.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0]
    two_zero = [9.0, 0.0, 7.0, None, 5.0, 4.0, 3.0, 2.0, 1.0]
    three_zero = [9.0, 0.0, 7.0, 0.0, 5.0, 0.0, 3.0, 2.0, 1.0]
    gap = [r for r in months("gap", nine + [1.0]) if r[1] != "2019-06-01"]
    data = (
        months("ok", nine) + months("two", two_zero) + months("three", three_zero)
        + gap + months("short", nine) + months("old", nine, (2015, 1)) + months("late_dry", nine + [0.0] * 3)
    )
    prod = aligned(spark, data)
    wells = headers(
        spark, ("ok", 10000), ("two", 10000), ("three", 10000), ("gap", 10000), ("short", 0),
        ("old", 10000), ("late_dry", 10000),
    )
    strict = curves.early_rates(prod, wells, BASINS)
    assert rows(strict, "well_id") == ["ok", "two"]
    loose = curves.early_rates(prod, wells, BASINS, max_history_zero=None)
    assert rows(loose, "well_id") == ["late_dry", "ok", "two"]
    row = strict.filter("well_id = 'two'").first()
    assert row.oil == [9.0, 0.0, 7.0, 0.0, 5.0, 4.0, 3.0, 2.0, 1.0]
    assert row.zero_months_count == 2
    assert row.cum_oil == 31.0 and row.avg_oil == pytest.approx(31 / 9)
    assert row.oil_norm[0] == pytest.approx(0.9)
    assert row.proppant_per_ft == pytest.approx(1500.0)


def test_two_dates_in_one_month_keep_the_later(spark):
    data = months("w", [9.0] + [1.0] * 9)
    extra = [("w", "2019-03-15", 5.0)]
    got = curves.history(aligned(spark, data + extra)).first()
    assert got.oil_curve[2] == 5.0
    assert got.window_rows == 10 and got.months_available == 10


def test_monthly_series_needs_exactly_nine_rows(spark):
    prod = aligned(spark, months("w", [9.0] * 1 + [1.0] * 11) + months("s", [9.0, 1.0]))
    got = curves.monthly_series(prod)
    assert rows(got, "well_id") == ["w"]
    assert got.first().oil == [9.0] + [1.0] * 8
