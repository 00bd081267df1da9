"""Radius joins and nearest-k searches without a spatial index.

A radius join is an equi-join on grid cells at least one radius wide: each target lies in
one cell, each candidate is listed in its own and the eight neighbouring cells, so every
pair within the radius meets exactly once.  A cheap chord test runs inside the join, the
exact spheroid distance only on what survives it.

Hot cells.  A cell may hold a large share of all wells.  The work of a cell is (targets x
candidates), so byte-based skew handling reacts too late.  A block should have a `BLOCKS`-th of a
task's share of all work, and no less than `LEAST_PAIRS`.  Cells whose product exceeds that are cut
into a grid of (target part, candidate part) blocks, both sides into parts of its square root of
rows; targets are repeated along one axis, candidates along the other, and each pair still meets in
exactly one block.  No row is dropped.  The list of hot cells is what gets broadcast: a cell
qualifies only with more than sqrt(LEAST_PAIRS) rows on one side, so it has at most
10 N / sqrt(LEAST_PAIRS) rows for N wells (120,000 rows for 24 million wells).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from wellkin.functions import geo

LEAST_PAIRS = 4_000_000
#: Blocks that a task should have on average, so that their sum is alike in all tasks.
BLOCKS = 8
#: Halvings of the radius that a ring search may start from.
HALVINGS = 6
#: Wells that every task may hold.
FEW_WELLS = 500_000
#: Columns by which a radius join is partitioned, beside its ``on`` columns.
CELL = ("_band", "_col", "_tpart", "_cpart")

_T = ("_tx", "_ty", "_tz")
_C = ("_cx", "_cy", "_cz")


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename every column but ``keep`` to ``prefix + name``, and ``well_id`` to ``id``."""
    names = {c: prefix + ("id" if c == "well_id" else c) for c in df.columns if c not in keep}
    return df.withColumnsRenamed(names)


def within_radius(
    targets: DataFrame,
    candidates: DataFrame,
    radius: str | float,
    on: tuple[str, ...] = ("basin_name",),
    where: str = "true",
    skip: DataFrame | None = None,
    pairs_per_task: int | None = None,
    cells: bool = False,
    whole_targets: bool = False,
) -> DataFrame:
    """All (target, candidate) pairs within ``radius`` miles, with ``distance_mi``.

    ``targets`` has ``target_id``, ``target_lat``, ``target_lon`` and further ``target_``
    columns, ``candidates`` the same with ``candidate_``; both have the ``on`` columns,
    which must be equal.  ``radius`` is a number or a SQL expression over the ``on``
    columns.  ``where`` is tested inside the join, before any exact distance.  ``pairs_per_task``
    replaces the measured share of a block.  Targets whose
    value is in the only column of ``skip`` take no part.  ``cells`` keeps the `CELL` columns: the pairs lie
    partitioned by them, so a grouping by them and the target needs no exchange.  With
    ``whole_targets`` cells are cut along the targets alone: a target meets all its candidates in one block.

    The targets are partitioned by the join keys up front.  A sorted or hashed join needs
    that exchange anyway; when Spark broadcasts the candidates instead, it keeps a few small
    input files from putting all the pair tests into one task.

    All tests stand in the join condition, cheapest first: a filter on the distance after
    the join would be pushed in front of them and run the full formula on every pair of a
    cell.
    """
    spark = targets.sparkSession
    radius = f"{float(radius)}D" if isinstance(radius, (int, float)) else radius
    cell = ", ".join([*on, "_band", "_col"])
    keys = f"{cell}, _tpart, _cpart"
    same = " AND ".join(f"l.{k} = r.{k}" for k in keys.split(", "))
    shared = [f"l.{c}" for c in on]
    if cells:
        shared += [f"l.{c}" for c in CELL]
    t_columns = shared + [f"l.{c}" for c in targets.columns if c not in on]
    c_columns = [f"r.{c}" for c in candidates.columns if c not in on]
    width = geo.band_width("_band", "_radius")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = f"(SELECT sum(double(_nt) * _nc) FROM work) / {tasks * BLOCKS}"
    most = f"greatest({LEAST_PAIRS}D, {share})" if pairs_per_task is None else f"{pairs_per_task}D"
    parts = "ceil(_nt / sqrt(_most)) AS _tparts, ceil(_nc / sqrt(_most)) AS _cparts"
    if whole_targets:
        parts = "least(_nt, ceil(double(_nt) * _nc / _most)) AS _tparts, 1L AS _cparts"
    views, unskipped = {"targets": targets, "candidates": candidates}, ""
    if skip is not None:
        views["skip"] = skip
        key = skip.columns[0]
        unskipped = f"LEFT ANTI JOIN {{skip}} AS s ON t.{key} = s.{key}"
    query = f"""
WITH t AS (
  SELECT *, {geo.unit_vector('_beta', 'target_lon', _T)}, floor(target_lon / {width}) AS _col
  FROM (SELECT *, coalesce({radius}, -1D) AS _radius,
          coalesce({geo.half_chord_limit(radius)}, -1D) AS _limit,
          {geo.reduced_latitude('target_lat')} AS _beta,
          {geo.lat_band('target_lat', radius)} AS _band
        FROM {{targets}})
), c AS (
  SELECT *, {geo.unit_vector('_beta', 'candidate_lon', _C)},
    explode(transform(array(-1, 0, 1), i -> i + floor(candidate_lon / {width}))) AS _col
  FROM (SELECT *, {radius} AS _radius, {geo.reduced_latitude('candidate_lat')} AS _beta,
          explode(transform(array(-1, 0, 1),
            i -> i + {geo.lat_band('candidate_lat', radius)})) AS _band
        FROM {{candidates}})
), work AS (
  SELECT {cell}, sum(_nt) AS _nt, sum(_nc) AS _nc
  FROM (SELECT {cell}, 1 AS _nt, 0 AS _nc FROM t
        UNION ALL SELECT {cell}, 0, 1 FROM c)
  GROUP BY {cell}
), load AS (
  SELECT {cell}, {parts}
  FROM (SELECT *, {most} AS _most FROM work)
  WHERE double(_nt) * _nc > _most
), l AS (
  SELECT /*+ REPARTITION({tasks}, {keys}) */ * FROM (
    SELECT /*+ BROADCAST(load) */ *, pmod(xxhash64(target_id), coalesce(_tparts, 1)) AS _tpart,
      explode(sequence(0L, coalesce(_cparts, 1) - 1)) AS _cpart
    FROM (SELECT t.* FROM t {unskipped}) LEFT JOIN load USING ({cell}))
), r AS (
  SELECT /*+ BROADCAST(load) */ *, pmod(xxhash64(candidate_id), coalesce(_cparts, 1)) AS _cpart,
    explode(sequence(0L, coalesce(_tparts, 1) - 1)) AS _tpart
  FROM c LEFT JOIN load USING ({cell})
), pairs AS (
  SELECT {', '.join(t_columns + c_columns)}, {', '.join(_T + _C)},
    {geo.half_chord_sq(_T, _C)} AS _h
  FROM l JOIN r ON {same} AND {where}
    AND {geo.half_chord_sq(_T, _C)} <= _limit AND {geo.distance_mi(_T, _C)} <= l._radius
)
SELECT * EXCEPT ({', '.join(_T + _C)}, _h, _sigma, _sine),
  {geo.miles('_h', '_sigma', '_sine', _T[2], _C[2])} AS distance_mi
FROM (SELECT *, 2 * asin(sqrt(_h)) AS _sigma, 2 * sqrt(_h * (1 - _h)) AS _sine FROM pairs)
"""
    return spark.sql(query, **views)


def top_by_distance(
    pairs: DataFrame,
    k: int,
    rank: str = "analog_rank",
    by: tuple[str, str] = ("target_id", "candidate_id"),
) -> DataFrame:
    """The k nearest candidates of each target, nearest first, ties by id.

    ``by`` names the columns that tell targets apart and that order candidates.

    Spark turns the rank filter into a per-task top-k before the shuffle, so a target with
    very many candidates sends at most k of them per task.
    """
    nearest = Window.partitionBy(by[0]).orderBy("distance_mi", by[1])
    return pairs.withColumn(rank, F.row_number().over(nearest)).filter(F.col(rank) <= k)


def ring_starts(
    targets: DataFrame,
    candidates: DataFrame,
    radius: str | float,
    k: int,
    on: tuple[str, ...] = ("basin_name",),
    halvings: int = HALVINGS,
) -> DataFrame:
    """``targets`` with ``_ring``: how often the radius is halved where their search starts.

    It is the smallest grid cell around the target that holds k candidates: a grid of the
    halved radius, so what lies within that radius covers about three such cells, and the
    next smaller cell held fewer than k.  Only cells that hold k candidates are listed.
    """
    radius = f"{float(radius)}D" if isinstance(radius, (int, float)) else f"({radius})"
    grouped = "".join(f"{c}, " for c in on)
    same = "".join(f"t.{c} <=> f.{c} AND " for c in on)

    def cell(side: str) -> str:
        width = geo.band_width("_band", "_reach")
        return f"""
  SELECT *, floor({side}_lon / {width}) AS _col FROM (
    SELECT *, {geo.lat_band(f"{side}_lat", "_reach")} AS _band FROM (
      SELECT *, {radius} / shiftleft(1L, _ring) AS _reach FROM (
        SELECT *, explode(sequence(1, {halvings})) AS _ring FROM {{{side}s}})))"""

    return targets.sparkSession.sql(
        f"""
WITH full AS (
  SELECT {grouped}_ring, _band, _col FROM ({cell("candidate")})
  GROUP BY {grouped}_ring, _band, _col HAVING count(*) >= {k}
), start AS (
  SELECT target_id, max(t._ring) AS _ring FROM ({cell("target")}) AS t JOIN full AS f
    ON {same}t._ring = f._ring AND t._band = f._band AND t._col = f._col
  GROUP BY target_id)
SELECT t.*, coalesce(s._ring, 0) AS _ring FROM {{targets}} AS t LEFT JOIN start AS s USING (target_id)
""",
        targets=targets,
        candidates=candidates,
    ).select(*targets.columns, "_ring")


def nearest_within(
    targets: DataFrame,
    candidates: DataFrame,
    radius: str | float,
    k: int,
    on: tuple[str, ...] = ("basin_name",),
    where: str = "true",
    halvings: int = HALVINGS,
) -> DataFrame:
    """The k nearest candidates within the radius, with ``analog_rank``.

    A target searches growing rings: it starts at the radius halved as often as the density
    around it allows (`ring_starts`), and doubles it until it has found k candidates.  Nothing
    outside can then be nearer than its k-th, so the result is that of the whole radius, while
    the pairs formed follow k and not the density.  Targets whose rule leaves them few
    candidates go on to the whole radius.

    Each ring is a radius join of the targets that need it.  It first counts, and keeps the targets
    that have k candidates by a checkpoint in the shared folder; their pairs are formed again where they are ranked, so no
    pair is written.  Where no cell of half the radius holds k candidates, as in small or sparse
    tables, one join of all is made.

    The pairs of a target lie in one block, so they are ranked where the join left them, beside their
    target's columns, and nothing is exchanged.  Targets that share an id share their k places; their
    pairs are put together, as numbers and a distance, and meet their columns after the cut.  So do
    the candidates' columns.
    """
    known = _numbered_candidates(candidates).checkpoint()
    started = _numbered_targets(ring_starts(targets, candidates, radius, k, on, halvings)).checkpoint()
    kinds = started.select("_ring", "_alone").distinct().collect()
    whole = f"{float(radius)}D" if isinstance(radius, (int, float)) else f"({radius})"
    beside = known.drop(*on)
    few = known.limit(FEW_WELLS + 1).count() <= FEW_WELLS
    beside = F.broadcast(beside) if few else beside
    own = [*on, *_other(targets, on)]

    def formed(seeking: DataFrame, reach: str | float, done: DataFrame | None) -> DataFrame:
        return within_radius(seeking, known, reach, on, where, done, cells=True, whole_targets=True)

    def nearest(seeking: DataFrame, reach: str | float, done: DataFrame | None) -> DataFrame:
        made = []
        if any(r._alone for r in kinds) or not kinds:
            pairs = formed(seeking.filter("_alone"), reach, done).select(
                *own, *CELL, "_row", "_number", "distance_mi"
            )
            here = Window.partitionBy(*on, *CELL, "_row").orderBy("distance_mi", "_number")
            made.append(pairs.withColumn("analog_rank", F.row_number().over(here)).filter(F.col("analog_rank") <= k))
        if not all(r._alone for r in kinds):
            pairs = formed(seeking.filter("NOT _alone"), reach, done)
            near = top_by_distance(pairs.select("_group", "_row", "_number", "distance_mi"), k, by=("_group", "_number"))
            full = started.alias("t").join(near.alias("p"), F.expr("t._group = p._group AND t._row = p._row"))
            made.append(full.selectExpr("t.*", "p._number", "p.distance_mi", "p.analog_rank"))
        kept = [m.select(*own, "_number", "distance_mi", "analog_rank") for m in made]
        return (
            reduce(DataFrame.unionByName, kept)
            .join(beside, "_number")
            .select(*own, *_other(candidates, on), "distance_mi", "analog_rank")
        )

    found, done = [], None
    for ring in range(max((r._ring for r in kinds), default=0), 0, -1):
        seeking = started.filter(F.col("_ring") >= ring).drop("_ring")
        reach = f"{whole} / {1 << ring}"
        counted = formed(seeking, reach, done).groupBy("_group").agg(F.count("*").alias("_n"))
        complete = counted.filter(F.col("_n") >= k).select("_group").checkpoint()
        found.append(nearest(seeking.join(complete, "_group", "left_semi"), reach, None))
        done = complete if done is None else done.unionByName(complete)
    found.append(nearest(started.drop("_ring"), radius, done))
    return reduce(DataFrame.unionByName, found)


def _other(df: DataFrame, on: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in on]


def _numbered_targets(targets: DataFrame) -> DataFrame:
    """``_row`` numbers the rows, ``_group`` is the number of a target id, ``_alone`` says that no other
    row has that id.

    The numbers are taken where the rows of an id lie together, in the stage that is checkpointed."""
    placed = targets.repartition("target_id").withColumn("_row", F.monotonically_increasing_id())
    same = Window.partitionBy("target_id")
    return placed.withColumns({"_group": F.min("_row").over(same), "_alone": F.count("*").over(same) == 1})


def _numbered_candidates(candidates: DataFrame) -> DataFrame:
    """``_number`` numbers the rows in order of their ids."""
    return candidates.orderBy("candidate_id").withColumn("_number", F.monotonically_increasing_id())
