"""Hyper-parameter values: the grid of topic counts and Dirichlet priors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the default grid.
TOPIC_START, TOPIC_END, TOPIC_STEP = 20, 120, 5
PRIOR_START, PRIOR_END, PRIOR_STEP = 0.01, 1.0, 0.3
GAMMA_START, GAMMA_END, GAMMA_STEP = 0.001, 0.010, 0.001
TYPES = ["eval", "train"]
PRIOR_WORDS = ["symmetric", "asymmetric"]

TOPIC_COUNTS = list(range(TOPIC_START, TOPIC_END + 1, TOPIC_STEP))
PRIOR_BASE = len(TOPIC_COUNTS)  # the symmetric prior divides by the number of topic counts, 21
PRIOR_NUMBERS = [PRIOR_START + i * PRIOR_STEP for i in range(4)]
ALPHA_LABELS = PRIOR_WORDS + [str(v) for v in PRIOR_NUMBERS]
BETA_LABELS = PRIOR_WORDS[:1] + [str(v) for v in PRIOR_NUMBERS]
GAMMA_VALUES = [round(GAMMA_START + i * GAMMA_STEP, 3) for i in range(10)]

DECIMAL = "decimal(38,18)"


def numeric_alpha(label: Column, prior_base: int = PRIOR_BASE) -> Column:
    """symmetric -> 1/n, asymmetric -> 1/(n+sqrt n), anything else its number (null when not a number)."""
    asymmetric = 1.0 / (prior_base + prior_base**0.5)
    return (
        F.when(label == "symmetric", F.lit(1.0 / prior_base).cast(DECIMAL))
        .when(label == "asymmetric", F.lit(asymmetric).cast(DECIMAL))
        .otherwise(label.try_cast(DECIMAL))
    )


def numeric_beta(label: Column, prior_base: int = PRIOR_BASE) -> Column:
    """symmetric -> 1/n, anything else its number (null when not a number)."""
    return F.when(label == "symmetric", F.lit(1.0 / prior_base).cast(DECIMAL)).otherwise(label.try_cast(DECIMAL))


def prior_is_valid(label: Column) -> Column:
    """True for the two names and for numbers."""
    return F.coalesce(label.isin(PRIOR_WORDS) | label.try_cast(DECIMAL).isNotNull(), F.lit(False))


def require_priors(alpha: Column, beta: Column) -> Column:
    """True, or an error that names the first bad label."""
    def check(label: Column, what: str) -> Column:
        message = F.concat(F.lit(f"invalid {what}: "), F.coalesce(label, F.lit("null")))
        return F.when(prior_is_valid(label), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))

    return check(alpha, "alpha_str") & check(beta, "beta_str")


def prior_label(number: Column) -> Column:
    return number.cast("string")


def vector_prior(k: int, asymmetric: bool = True) -> list[float]:
    """Per-topic prior: 1/(i + sqrt k) normalised, or 1/k for all."""
    raw = [1.0 / (i + k**0.5) if asymmetric else 1.0 for i in range(k)]
    return [v / sum(raw) for v in raw]


def chunk_size(documents: Column) -> Column:
    """A fifth of the documents, rounded down."""
    return F.floor(documents / 5)
