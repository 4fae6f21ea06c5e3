"""Reproducible train/eval split and batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import shuffle_hash, shuffled_rank

TRAIN_RATIO = 0.8
BATCH_SIZE = 50


def split_train_eval(docs: DataFrame, key: str, seed: int | str, ratio: float = TRAIN_RATIO) -> DataFrame:
    """Add split: the first floor(ratio * n) rows of a seeded shuffle are train, the rest eval.

    Only keys are counted, and only 1/4096 of them ranked, to find the last train key; the documents are
    labelled in place by comparing with it and never move.
    """
    keys = docs.select(F.col(key).alias("_key")).select("_key", shuffle_hash("_key", seed).alias("_h"))
    bucket = F.substring("_h", 1, 3)
    sizes = sorted(tuple(r) for r in keys.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())
    need = math.floor(sum(n for _, n in sizes) * ratio)
    cut = None
    for b, n in sizes:
        if 0 < need <= n:
            cut = b
            break
        need -= n
    if cut is None:
        return docs.withColumn("split", F.lit("eval"))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy("_h", "_key"))
    last = keys.filter(bucket == cut).withColumn("_r", place).filter(F.col("_r") == need).first()
    h = shuffle_hash(key, seed)
    train = (h < last["_h"]) | ((h == last["_h"]) & (F.col(key) <= F.lit(last["_key"])))
    return docs.withColumn("split", F.when(train, "train").otherwise("eval"))


def assign_batches(
    docs: DataFrame, key: str, seed: int | str, ratio: float = TRAIN_RATIO, size: int = BATCH_SIZE
) -> DataFrame:
    """Add split, batch_id and pos: consecutive slices of `size` in each split, the short last one kept.

    The rank decides all three, so no second shuffle is needed.
    """
    n_train = docs.agg(F.floor(F.count("*") * F.lit(ratio))).scalar()
    ranked = shuffled_rank(docs, key, seed).withColumn("_t", n_train)
    train = F.col("rank") <= F.col("_t")
    at = F.when(train, F.col("rank") - 1).otherwise(F.col("rank") - 1 - F.col("_t"))
    return (
        ranked.withColumn("split", F.when(train, "train").otherwise("eval"))
        .withColumn("batch_id", F.floor(at / size))
        .withColumn("pos", F.pmod(at, F.lit(size)).cast("bigint"))
        .drop("_t", "rank")
    )
