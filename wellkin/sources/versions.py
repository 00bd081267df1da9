"""Tables that change by whole versions.

A table is a folder of runs and of commits.  Rows are written beside what is there, under a run
of their own; the change then becomes visible by one commit record, a file of one line, which
says which values of the partition column the run holds from now on.  Spark's writer shows that
file only when it is complete.  A reader takes each value's rows from the run of its latest
commit, so it never sees half a basin, and a run that fails before its commit changes nothing.

Two writers at once are told apart by the number of their commit, equal numbers by the run's
name: for values both replaced, one run wins as a whole.  A merge is made from what is read at
its start, so merges of one table must follow each other.  Runs that no commit needs any more
stay until the folder's owner removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wellkin.sources import merge

_COMMIT = "number long, run string, column string, held array<string>, fields string"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_COMMIT).json(f"{path}/commits")


def _last(spark: SparkSession, path: str):
    """The latest commit, None for a table without one."""
    try:
        return _commits(spark, path).orderBy(F.desc("number"), F.desc("run")).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _commit(spark: SparkSession, path: str, run: str, column: str, held: list, fields: str) -> None:
    last = _last(spark, path)
    number = last.number + 1 if last else 0
    record = spark.createDataFrame([(number, run, column, held, fields)], _COMMIT)
    record.coalesce(1).write.mode("append").json(f"{path}/commits")


def publish(
    df: DataFrame, path: str, column: str = "basin_name", emptied: tuple[str | None, ...] = ()
) -> str:
    """Replace the rows of the values of ``column`` that ``df`` holds; returns the run.

    The values are read from the run as written.  Values named in ``emptied`` are replaced too,
    by no rows where ``df`` has none; others keep their rows.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    beside = f"{path}/runs/run={run}"
    df.write.partitionBy(column).parquet(beside)
    written = spark.read.schema(df.schema).parquet(beside)
    held = [r[0] for r in written.select(F.col(column).cast("string")).distinct().collect()]
    held += [v for v in emptied if v not in held]
    _commit(spark, path, run, column, held, df.schema.json())
    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each value's latest run, as one table."""
    last = _last(spark, path)
    if last is None:
        raise ValueError(f"no version of {path} is published")
    fields = T.StructType.fromJson(json.loads(last.fields))
    latest = (
        _commits(spark, path)
        .select("number", "run", F.explode("held").alias("value"))
        .groupBy("value")
        .agg(F.max_by("run", F.struct("number", "run")).alias("run"))
        .collect()
    )
    runs: dict[str, list] = {}
    for row in latest:
        runs.setdefault(row.run, []).append(row.value)
    value, shown = F.col(last.column).cast("string"), F.lit(False)
    for run, held in runs.items():
        known = [v for v in held if v is not None]
        own = value.isin(known) if known else F.lit(False)
        if None in held:
            own = own | value.isNull()
        shown = shown | ((F.col("run") == run) & F.coalesce(own, F.lit(False)))
    every = spark.read.schema(T.StructType([*fields, T.StructField("run", T.StringType())]))
    return every.parquet(f"{path}/runs").filter(shown).select(*fields.fieldNames())


def publish_upsert(
    new: DataFrame,
    path: str,
    keys: list[str],
    update: list[str] | None = None,
    column: str = "basin_name",
) -> str:
    """`merge.upsert` into the published table, as a new version of every value it reaches.

    A key whose row moves to another value of ``column`` leaves the old one, so both are
    written anew; values that ``new`` does not touch are not read.
    """
    spark = new.sparkSession
    old = read(spark, path)
    met = old.join(new.select(*keys), keys, "left_semi").select(column)
    reached = met.unionByName(new.select(column)) if column in new.columns else met
    values = [r[0] for r in reached.select(F.col(column).cast("string")).distinct().collect()]
    known = [v for v in values if v is not None]
    own = F.col(column).cast("string").isin(known) if known else F.lit(False)
    if None in values:
        own = own | F.col(column).isNull()
    part = old.filter(F.coalesce(own, F.lit(False)))
    return publish(merge.upsert(part, new, keys, update), path, column, tuple(values))
