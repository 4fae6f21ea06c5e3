"""Hyper-parameter grids: products, samples, pairing with batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import priors as P
from .ranking import running_total, shuffle_hash, shuffled_rank

SAMPLE_FRACTION = 0.375


def product(spark: SparkSession, axes: dict[str, Sequence]) -> DataFrame:
    """All combinations of the axis values, by exploding one literal array per axis."""
    grid = spark.range(1).select()
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def hyperparameter_grid(spark: SparkSession, gamma: bool = False) -> DataFrame:
    """topics, alpha_str, beta_str, type (1,260 rows); early drafts add gamma."""
    axes: dict[str, Sequence] = {"topics": P.TOPIC_COUNTS, "alpha_str": P.ALPHA_LABELS, "beta_str": P.BETA_LABELS}
    if gamma:
        axes["gamma"] = P.GAMMA_VALUES
    return product(spark, {**axes, "type": P.TYPES})


def grid_of_levels(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """All combinations of the levels seen in each column of `rows`; levels are few by nature."""
    levels = rows.agg(*[F.array_sort(F.collect_set(a)).alias(a) for a in axes])
    for a in axes:
        levels = levels.withColumn(a, F.explode(a))
    return levels


def combo_key(axes: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(a).cast("string") for a in axes])


def sample_grid(grid: DataFrame, axes: Sequence[str], seed: int | str, fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """max(1, int(n * fraction)) combinations without replacement; all when that is not fewer than n."""
    take = grid.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(fraction)))).scalar()
    ranked = shuffled_rank(grid.withColumn("_key", combo_key(axes)), "_key", seed, "_rank")
    return ranked.withColumn("_take", take).filter(F.col("_rank") <= F.col("_take")).drop("_key", "_rank", "_take")


def balanced_sample(rows: DataFrame, group: str, key: str, seed: int | str) -> DataFrame:
    """The same number of seeded draws from each group: the size of the smallest."""
    least = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n")).scalar()
    ranked = running_total(rows.withColumn("_h", shuffle_hash(key, seed)), [F.col("_h"), F.col(key)], [group], name="_r")
    return ranked.withColumn("_n", least).filter("_r <= _n").drop("_h", "_r", "_n")


def undrawn(grid: DataFrame, drawn: DataFrame) -> DataFrame:
    """Combinations that were not drawn."""
    return grid.exceptAll(drawn.select(*grid.columns))


def with_grid(batches: DataFrame, grid: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Every combination with every batch. The grid (at most a few thousand rows) rides along as one array."""
    points = grid.agg(F.array_sort(F.collect_list(F.struct(*axes)))).scalar()
    return batches.withColumn("_g", F.explode(points)).select(*batches.columns, "_g.*")
