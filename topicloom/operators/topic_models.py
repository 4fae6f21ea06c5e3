"""One topic model over a corpus: fit, scores, document topics, words of the topics and the parameter search.

Thin forms of `corpus_models` for a single model; the number of terms is not limited.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus_models as CM
from .geometry import top_words

PASSES, RANDOM_STATE = 15, 75


@dataclass(frozen=True)
class TopicModel:
    """A fitted model: its setting and its table of weights (term, part, weights)."""

    setting: CM.Model
    weights: DataFrame

    def topic_rows(self) -> DataFrame:
        """topic, term, weight: every term of the corpus in every topic."""
        return CM.topic_rows(self.weights, [self.setting])

    def topic_words(self, n: int | None = None) -> DataFrame:
        """topic, place, term, weight: the n heaviest terms of each topic (all by default, without places)."""
        rows = self.topic_rows()
        return rows if n is None else top_words(rows, n).select("topic", "place", "term", "weight")

    def scores(self, packed: DataFrame) -> DataFrame:
        """n_docs, n_tokens, bound, per_word_bound, perplexity (base e) and perplexity_base2 of documents, which may be held out."""
        return CM.corpus_scores(packed, self.weights, [self.setting]).drop("model", "held_out")

    def doc_topics(self, packed: DataFrame) -> DataFrame:
        """doc_id, n_tokens, bound, per_word_bound, distribution: all documents and topics."""
        return CM.document_topics(packed, self.weights, [self.setting])


def fit_topics(
    packed: DataFrame,
    k: int,
    alpha: float | Sequence[float],
    eta: float,
    passes: int = PASSES,
    decay: float = 0.5,
    offset: float = 1.0,
    seed: int = RANDOM_STATE,
    iterations: int = 50,
) -> TopicModel:
    """Fit on documents packed by `corpus_models.pack`; each pass uses the whole corpus. `alpha` is one number or k of them."""
    prior = float(alpha) if isinstance(alpha, (int, float)) else tuple(float(a) for a in alpha)
    setting = CM.Model(k, prior, float(eta), decay, offset)
    return TopicModel(setting, CM.fit(packed, [setting], passes, seed, iterations))


def best_point(results: DataFrame) -> DataFrame:
    """Mean scores per grid point, best first."""
    return (
        results.groupBy("k", "alpha", "eta", "decay")
        .agg(F.avg("score").alias("mean_score"), F.avg("train_score").alias("mean_train_score"), F.count("*").alias("n_splits"))
        .orderBy(F.col("mean_score").desc(), "k", "alpha", "eta", "decay")
    )
