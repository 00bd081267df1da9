"""Tables written between steps.

The steps of the workload hand each other stored tables.  Here a step's table is Parquet in
the shared folder the session names in ``spark.checkpoint.dir``: it cuts the lineage,
survives the loss of executors, and the next step prunes its columns and reads its
statistics, which a checkpointed RDD would not allow.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The configured shared folder; a temporary one only in local mode."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        _fallback[app] = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return _fallback[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing was written to."""
    return f"{shared_folder(spark)}/wellkin/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4()}"


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Folders that a task writes side by side; beyond them it sorts its rows first.
OPEN_FOLDERS = 16


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """Rows of few folders are written as they come, not sorted by folder."""
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, str(OPEN_FOLDERS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a step's result under a fresh path and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if partition_by:
        with _unsorted(spark):
            df.write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """The stored tables of one input folder, each built once per Spark application."""

    _made: dict[tuple[str, str], Steps] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._tables, self._values = spark, sf_dir, {}, {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Steps:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._made:
            cls._made[key] = cls(spark, sf_dir)
        return cls._made[key]

    def table(self, name: str, build, partition_by: str | None = None) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = store(build(), name, partition_by)
        return self._tables[name]

    def table_if_made(self, name: str) -> DataFrame | None:
        return self._tables.get(name)

    def once(self, name: str, build):
        """What a step leaves with the driver, such as trained models, made once."""
        if name not in self._values:
            self._values[name] = build()
        return self._values[name]
