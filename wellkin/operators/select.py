"""Analog selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellkin.operators.radius import top_by_distance


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """W3."""
    return top_by_distance(pairs, k)


def _by_score(*partition: str):
    return Window.partitionBy(*partition).orderBy(
        F.col("score").desc(), "distance_mi", "candidate_id"
    )


def best(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The k highest scores of each target, ties by distance and id."""
    return pairs.withColumn("analog_rank", F.row_number().over(_by_score("target_id"))).filter(
        F.col("analog_rank") <= k
    )


def diverse(
    pairs: DataFrame,
    k: int = 20,
    per_operator: int = 3,
    operator: str = "candidate_operator_name",
) -> DataFrame:
    """The k highest scores with at most ``per_operator`` of one operator.

    Taking the best few of each operator and then the best k of those equals picking
    greedily in score order; both cuts are rank filters that run before their shuffle.
    Missing operators count as one operator.
    """
    few = pairs.withColumn(
        "_rank", F.row_number().over(_by_score("target_id", operator))
    ).filter(F.col("_rank") <= per_operator)
    return best(few.drop("_rank"), k)


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values, ties by value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("_n"))
        .orderBy(F.col("_n").desc(), column)
        .limit(n)
        .select(column)
    )


def flag_top_categories(
    df: DataFrame, column: str, n: int = 10, flag: str = "is_major_operator"
) -> DataFrame:
    """1 where the value is among the n most frequent.  The broadcast side has n rows."""
    major = top_categories(df, column, n).withColumn(flag, F.lit(1))
    return df.join(F.broadcast(major), column, "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(0))
    )
