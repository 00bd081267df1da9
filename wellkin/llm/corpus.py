"""The tables and the few column helpers that the training-data operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, key: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 2; false for a null id."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == 2, F.lit(False))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one scan, used to choose how many blocks to deal rows into."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def blocks_for(n_bytes: int, block_bytes: int, least: int = 256) -> int:
    """As many blocks as give each about `block_bytes`; small inputs get `least`."""
    return max(least, -(-n_bytes // block_bytes))


def blocked(docs: DataFrame, n_blocks: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, row_key, `extra` columns and block: a block is a bounded, repeatable share of the rows.

    The key hashes id and text, so rows with one id and different texts stay apart and a row
    gets the same key whenever it is read again.
    """
    key = F.xxhash64("doc_id", "text")
    return docs.select("doc_id", "text", key.alias("row_key"), *extra).withColumn(
        "block", F.pmod("row_key", F.lit(n_blocks)).cast("int")
    )


def fit_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """What `fit` makes of a sample whose size the caller has bounded, fitted in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(fit(rows))]})

    made = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit(pd.DataFrame(columns=sample.columns))


def low_hashes(rows: DataFrame, key: Column, size: int) -> DataFrame:
    """`rows` with `k`, cut to the lowest values of the hash `key`: about twice `size` rows.

    Taking the `size` lowest of these in one task then reads a bounded number of rows, however
    many partitions there are.  The cut depends on the number of rows alone.
    """
    total = max(1, rows.count())
    share = min(1.0, 2 * size / total)
    keyed = rows.withColumn("k", key)
    return keyed if share >= 1 else keyed.filter(F.col("k") < F.lit(int(-(2**63) + share * 2**64)))
