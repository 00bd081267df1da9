"""A nearest-k search ranks numbers and distances; columns follow after the cut."""

import pytest
from pyspark.sql import functions as F

from tests.test_pairs import points, sides
from wellkin.operators import radius


@pytest.mark.parametrize("k", [3, 400])
def test_cut_pairs_are_numbers_and_rows_may_repeat(spark, monkeypatch, k):
    _, df = points(spark, 90, 21, ((40.0, 40.1), (-104.6, -104.5)))
    nameless = df.limit(4).withColumn("well_id", F.lit(None).cast("string"))
    t, c = sides(df.unionByName(df.limit(20)).unionByName(nameless).withColumn("note", F.lit("n" * 50)))
    columns = sorted(x for x in (*t.columns, *c.columns) if x != "basin_name")
    whole = radius.top_by_distance(radius.within_radius(t, c, 15.0), k)
    seen, cut = [], radius.top_by_distance
    monkeypatch.setattr(radius, "top_by_distance", lambda pairs, *a, **n: seen.append(pairs) or cut(pairs, *a, **n))
    found = radius.nearest_within(t, c, 15.0, k)
    assert seen and all(len(pairs.columns) == 4 for pairs in seen)

    # Of rows alike in id and distance any may have a place, so those are compared without the rest.
    def ranked(made):
        return sorted(map(str, made.select("target_id", "candidate_id", "analog_rank", "basin_name").collect()))

    assert set(columns) < set(found.columns) and found.filter("target_note <> candidate_note").count() == 0
    named = "target_id IS NOT NULL"
    assert ranked(found.filter(named)) == ranked(whole.filter(named))
    assert k < 400 or found.count() == whole.count() > 5_000
