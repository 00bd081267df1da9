"""JDBC tables (S2, S3, S3b).  Connection details always come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_BATCH = 10_000


def read_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    table: str,
    columns: list[str] | None = None,
    split: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """A table, pruned to ``columns`` in the database.

    ``split`` = (numeric or date column, lower, upper, partitions) reads in parallel;
    without it one task reads the whole table.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if split:
        column, lower, upper, partitions = split
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    df = reader.load()
    return df.select(*columns) if columns else df


def write_jdbc(
    df: DataFrame,
    options: dict[str, str],
    table: str,
    mode: str = "overwrite",
    batch_size: int = DEFAULT_BATCH,
    connections: int | None = None,
) -> None:
    """S3 (``overwrite``) and S3b (``append``): batched insert, one connection per task.

    ``connections`` caps the writers through Spark's own ``numPartitions``, so a wide
    frame does not open one database connection per shuffle partition.
    """
    writer = (
        df.write.format("jdbc")
        .mode(mode)
        .options(**options)
        .option("dbtable", table)
        .option("batchsize", batch_size)
    )
    if connections:
        writer = writer.option("numPartitions", connections)
    writer.save()
