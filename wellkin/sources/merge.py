"""Updates of stored tables as joins that write a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None
) -> DataFrame:
    """Insert unseen keys; on a known key replace only the ``update`` columns.

    ``new`` must hold at most one row per key.  Replaced columns take the new value even
    when it is null, as ``SET x = EXCLUDED.x`` does.
    """
    update = [c for c in old.columns if c not in keys] if update is None else update
    fresh = new.select(
        *keys, F.struct(*[c for c in old.columns if c in new.columns]).alias("_new")
    )
    stored = old.select(*keys, F.struct(*old.columns).alias("_old"))
    joined = stored.join(fresh, keys, "full")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def merged(name: str):
        before = F.col(f"_old.{name}")
        if name not in new.columns:
            return before.alias(name)
        after = F.col(f"_new.{name}")
        takes_new = has_new & (F.lit(name in update) | ~has_old)
        return F.when(takes_new, after).otherwise(before).alias(name)

    return joined.select(*[F.col(c) if c in keys else merged(c) for c in old.columns])


def replace_partition(df: DataFrame, path: str, column: str = "basin_name") -> None:
    """Replace only the partitions present in ``df``; the others stay."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def update_from(
    base: DataFrame, side: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """UPDATE base SET columns FROM side; rows without a match keep their value.

    ``side`` must hold at most one row per key.
    """
    renamed = side.select(*keys, *[F.col(c).alias(f"_side_{c}") for c in columns])
    joined = base.join(renamed, keys, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_side_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )
