"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one in HOT_SHARE of all rows, so there can never
# be more than HOT_SHARE hot keys, however large the data: safe to broadcast.
HOT_SHARE = 1 << 16


def _parts(table: DataFrame, key: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """(rows of hot keys, all rows), columns renamed for a join."""
    value_cols = [c for c in table.columns if c != key]
    hot = table.where(F.col(weight) * F.lit(HOT_SHARE)
                      > table.agg(F.sum(weight).alias("total")).scalar())
    return tuple(t.select(F.col(key).alias(f"_{name}_key"),
                          *[F.col(c).alias(f"_{name}_{c}") for c in value_cols])
                 for t, name in ((hot, "hot"), (table, "cold")))


def lookup_stored(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner form of `lookup_by_key` for stored rows, which it reads twice.

    Rows with a hot key are answered where they are and never move; only the others are
    shuffled. Both tables should be stored, as their columns are evaluated twice.
    """
    hot, cold = _parts(table, key, weight)
    keep = [F.col(c) for c in rows.columns]
    more = [c for c in table.columns if c not in rows.columns]
    near = rows.join(F.broadcast(hot), rows[key] == F.col("_hot_key"))
    far = rows.join(F.broadcast(hot.select("_hot_key")), rows[key] == F.col("_hot_key"), "left_anti")
    far = far.join(cold, far[key] == F.col("_cold_key"))
    return near.select(*keep, *[F.col(f"_hot_{c}").alias(c) for c in more]).unionByName(
        far.select(*keep, *[F.col(f"_cold_{c}").alias(c) for c in more]))


def lookup_by_key(rows: DataFrame, table: DataFrame, key: str, weight: str,
                  spread: Column, how: str = "inner") -> DataFrame:
    """Join `rows` with a table that is unique per `key` and knows each key's row count.

    Hot keys are answered from a broadcast of at most HOT_SHARE rows. Every other row is
    shuffled on the key; the answered ones travel under a spread key that matches
    nothing, so no partition receives more than its share. `key` must be a string.
    """
    value_cols = [c for c in table.columns if c != key]
    hot, cold = _parts(table, key, weight)
    first = rows.join(F.broadcast(hot), rows[key] == F.col("_hot_key"), "left")
    first = first.withColumn("_key", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(
        F.concat(F.lit("\x00"), F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("string"))))
    both = first.join(cold, first["_key"] == F.col("_cold_key"), "left")
    if how == "inner":
        both = both.where(F.col("_hot_key").isNotNull() | F.col("_cold_key").isNotNull())
    keep = [F.col(c) for c in rows.columns]
    return both.select(*keep, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c)
                                for c in value_cols if c not in rows.columns])
