"""Exact ranks, running totals and order statistics without one large sort partition.

`Window.partitionBy(group)` sends a whole group to one task, and an unpartitioned window the whole
table. The helpers here sort by range instead: equal keys are separated by the later order columns, so
a group of any size is cut into chunks, and only one small row per (chunk, group) is combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .skew import spread_join

HASH_BUCKETS = 4096  # three hex digits


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    weight: str | None = None,
    name: str = "running",
) -> DataFrame:
    """Add the running total of `weight` (row rank when None) per group in the given order.

    `order` must be total within the group for a reproducible answer. The sorted rows are written with their
    sort position: its high bits name the chunk, so ranks need one small row per (chunk, group) and no second
    sort.
    """
    group = list(group)
    placed = materialize(
        df.orderBy(*[F.col(g) for g in group], *order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_chunk", F.shiftright("_at", 33))
    size = F.count("*") if weight is None else F.sum(weight)
    per_chunk = placed.groupBy("_chunk", *group).agg(size.alias("_size"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        F.col("_chunk").alias("_c"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        "_first",
    )
    if weight is None:
        counted, inside = placed, F.col("_at") - F.col("_first") + 1
    else:
        upto = Window.partitionBy("_chunk", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        counted, inside = placed.withColumn("_inside", F.sum(weight).over(upto)), F.col("_inside")
    cond = counted["_chunk"] == offsets["_c"]
    for i, g in enumerate(group):
        cond = cond & counted[g].eqNullSafe(offsets[f"_g{i}"])
    return counted.join(offsets, cond).select(*df.columns, (F.col("_before") + inside).alias(name))


def row_index(df: DataFrame, order: Sequence[Column], name: str = "index") -> DataFrame:
    """1, 2, 3, ... over the whole table in the given order."""
    return running_total(df, order, name=name)


def shuffle_hash(key: str, seed: int | str) -> Column:
    """Reproducible shuffle key: md5 of `seed|key`."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def shuffled_rank(df: DataFrame, key: str, seed: int | str, name: str = "rank") -> DataFrame:
    """Exact 1-based rank in a seeded shuffle of `key`.

    md5 is uniform, so the first three hex digits cut the table into 4,096 even parts; the offsets
    table has at most that many rows and is safe to broadcast.
    """
    hashed = df.withColumn("_h", shuffle_hash(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = (
        df.select(F.substring(shuffle_hash(key, seed), 1, 3).alias("_b")).groupBy("_b").agg(F.count("*").alias("_n"))
    )
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("_h", key)
    return (
        hashed.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_b")
        .select(*df.columns, (F.col("_before") + F.col("_r")).alias(name))
    )


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, value, n - combined before the shuffle, so a hot group or value costs one row per task."""
    return df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))


def order_statistics(counts: DataFrame, group: Sequence[str], value: str, picks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each pick name -> (low, high) 1-based positions, the mean of the values at both positions.

    `counts` is given by value_counts. Positions are expressions over `_n`, the number of values in the group.
    """
    group = list(group)
    ranked = running_total(counts, [F.col(value)], group, "n", "_upto")
    totals = ranked.groupBy(*group).agg(F.max("_upto").alias("_n"), F.count("*").alias("_rows"))
    if group:
        placed = spread_join(ranked, totals, group, "_rows", [value])
    else:
        placed = ranked.withColumn("_n", totals.select("_n").scalar())

    def at(position: Column) -> Column:
        hit = (position > F.col("_upto") - F.col("n")) & (position <= F.col("_upto"))
        return F.max(F.when(hit, F.col(value)))

    return placed.groupBy(*group).agg(*[((at(lo) + at(hi)) / 2).alias(k) for k, (lo, hi) in picks.items()])


def most_frequent(counts: DataFrame, group: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The smallest of the most frequent values per group, from value_counts."""
    return counts.groupBy(*group).agg(F.max_by(value, F.struct(F.col("n"), -F.col(value))).alias(name))


def median_positions() -> tuple[Column, Column]:
    return F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)


def median(df: DataFrame, group: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group (mean of the middle pair)."""
    return order_statistics(value_counts(df, group, value), group, value, {name: median_positions()})
