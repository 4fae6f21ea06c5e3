"""Continue one topic model over time slices (years), with the topics kept as a table that grows with new terms.

A slice is packed once and visited by the blocks of `corpus_models`: there is one plan, whatever the number of terms and topics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus_models as CM


def fit_yearly(
    docs: DataFrame, years: Sequence[int], model: CM.Model, passes: int = 1, seed: int = 75, iterations: int = 50
) -> DataFrame:
    """First year fits, later years update: the topic table after the last year. `docs` has year, doc_id, tokens.

    Years without documents are passed over. An update counts as if all documents so far looked like the year's.
    """
    weights, step, seen = None, 0, 0
    for year in years:
        packed = CM.pack(docs.filter(F.col("year") == year))
        here = packed.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()[0]
        if here == 0:
            continue
        seen += here
        weights = CM.with_new_terms(weights, packed, [model], seed)
        weights = CM.advance(packed, weights, [model], range(step, step + passes), seen / here, iterations)
        step += passes
    if weights is None:
        raise ValueError("no documents in any of the years")
    return weights


def mean_doc_bound(scores: DataFrame) -> DataFrame:
    """Score (sum of bounds) and mean per-document per-word bound."""
    return scores.agg(F.sum("bound").alias("score"), F.avg("per_word_bound").alias("mean_doc_bound"), F.count("*").alias("n_docs"))
