"""Turning arrays into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: Sequence[str | Column], array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per non-null array element.

    An inner explode makes Catalyst infer `size(array) > 0` below it, which computes a costly array
    (tokenising, sorting) a second time; the outer form followed by a null test does not.
    """
    if pos is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.filter(F.col(name).isNotNull())
