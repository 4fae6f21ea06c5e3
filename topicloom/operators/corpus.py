"""Corpus preparation: metadata, joins, filters, collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .ranking import row_index


def merge_collections(*parts: DataFrame, key: str = "url", content: str = "content", order: str = "load_order") -> DataFrame:
    """Union of collections; for a repeated key the content with the highest load order stays."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy(key).agg(F.max_by(content, order).alias(content))


def date_key(metadata: DataFrame, date: str = "dl_date") -> DataFrame:
    """The columns used downstream and the year, 9999 when the date is missing."""
    return metadata.select("url", date, "series", "level", "lang", X.year_or_sentinel(F.col(date)).alias("year"))


def content_metadata_join(content: DataFrame, metadata: DataFrame, content_key: str, metadata_key: str) -> DataFrame:
    """Inner join on differently named keys; both key columns stay."""
    return content.join(metadata, content[content_key] == metadata[metadata_key], "inner")


def filter_articles(
    docs: DataFrame, years: Sequence[int], langs: Sequence[str] = ("en", "EN"), levels: Sequence[str] = ("article",)
) -> DataFrame:
    return docs.filter(F.col("year").isin(*years) & F.col("lang").isin(*langs) & F.col("level").isin(*levels))


def exclude_keys(docs: DataFrame, excluded: DataFrame, key: str, excluded_key: str) -> DataFrame:
    """Rows whose key is not on the list."""
    listed = excluded.select(F.col(excluded_key).alias("_x")).distinct()
    return docs.join(listed, docs[key] == listed["_x"], "left_anti")


def drop_empty(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return docs.filter(F.size(tokens) > 0)


def keys_consistent(left: DataFrame, right: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key of either side with its position in both and whether the two agree.

    `order` names the columns that give each side its original order.
    """
    by = [F.col(c) for c in order]
    need = list(dict.fromkeys([key, *order]))
    a = row_index(left.select(*need), by, "left_pos").select(F.col(key).alias("_l"), "left_pos")
    b = row_index(right.select(*need), by, "right_pos").select(F.col(key).alias("_r"), "right_pos")
    return a.join(b, a["_l"] == b["_r"], "full_outer").select(
        F.coalesce("_l", "_r").alias(key),
        "left_pos",
        "right_pos",
        F.col("left_pos").eqNullSafe(F.col("right_pos")).alias("consistent"),
    )


def prefix_rows(docs: DataFrame, tokens: str = "tokens", name: str = "prefix") -> DataFrame:
    """One row per token with the text of the document up to it; prefixes are built row by row."""
    at = docs.filter(F.size(tokens) > 0).withColumn("n_words", F.explode(F.sequence(F.lit(1), F.size(tokens))))
    return at.withColumn(name, F.array_join(F.slice(tokens, 1, F.col("n_words")), " ")).drop(tokens)
