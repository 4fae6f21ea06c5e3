"""Joins whose key may be very unevenly spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

HOT_KEYS = 1 << 16  # a hot key holds more than 1/65,536 of the rows, so there are fewer than 65,536
HOT_ROWS = 1_000_000  # and more rows than one task should take


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & left[k].eqNullSafe(right[f"{prefix}{i}"])
    return cond


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread_by: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join `rows` to `lookup`, where lookup.`weight` says how many rows carry each key. Nulls match nulls.

    The lookup is written once, because it is read for its totals and for the join. If no key is hot, this is a
    plain join. Otherwise each hot key is cut into as many parts as it has times the rows one part should take: `hot_rows`, or 1/65,536 of all
    rows where that is more. So fewer than 65,536 keys are hot (a proven bound for the broadcast of keys and parts), and no part is larger,
    however the rows are spread over the keys. Rows choose their part by a hash of `spread_by`, which is repeatable when a task is
    retried. Rows of keys that the lookup does not have (how="left") are left to adaptive execution, which splits the left side of such a join.
    """
    keys = list(keys)
    payload = [c for c in lookup.columns if c not in keys]
    lookup = materialize(lookup, "lookup")
    total, top = lookup.agg(F.sum(weight), F.max(weight)).first()
    part = max(hot_rows, (total or 0) // HOT_KEYS)
    if top is None or top <= part:
        side = lookup.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *payload)
        return rows.join(side, _match(rows, side, keys, "_k"), how).select(*[rows[c] for c in rows.columns], *payload)

    parts = F.ceil(F.col(weight) / part).cast("bigint")
    hot = lookup.filter(F.col(weight) > part).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], parts.alias("_parts"))
    salt = F.pmod(F.xxhash64(*spread_by), F.col("_parts"))
    salted = rows.join(F.broadcast(hot), _match(rows, hot, keys, "_h"), "left").select(
        *[rows[c] for c in rows.columns], F.coalesce(salt, F.lit(0).cast("bigint")).alias("_salt")
    )
    last = F.when(F.col(weight) > part, parts - 1).otherwise(F.lit(0)).cast("bigint")
    copies = lookup.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    copies = copies.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_s", *payload)
    cond = _match(salted, copies, keys, "_k") & (salted["_salt"] == copies["_s"])
    return salted.join(copies, cond, how).select(*[salted[c] for c in rows.columns], *payload)
