"""Distances between documents, the two-axis map, and the tables behind the interactive topic map."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

TIE_DIGITS = 9  # scores equal to this many digits are ties, broken by name


def js_distance(rows: DataFrame, batch: Sequence[str], key: str, distribution: str = "distribution") -> DataFrame:
    """batch..., key_1, key_2, js for all document pairs of a batch (of bounded size)."""
    batch = list(batch)
    a = rows.select(*batch, F.col(key).alias(f"{key}_1"), F.col(distribution).alias("_p"))
    b = rows.select(*batch, F.col(key).alias(f"{key}_2"), F.col(distribution).alias("_q"))
    return (
        a.join(b, batch)
        .filter(F.col(f"{key}_1") < F.col(f"{key}_2"))
        .select(*batch, f"{key}_1", f"{key}_2", X.js_divergence(F.col("_p"), F.col("_q")).alias("js"))
    )


def classical_scaling(distances: np.ndarray, axes: int = 2) -> np.ndarray:
    """Coordinates whose distances approximate the given ones; the largest entry of each axis is positive."""
    n = len(distances)
    centre = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (distances**2) @ centre)
    top = np.argsort(values)[::-1][:axes]
    out = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    if out.shape[1] < axes:
        out = np.pad(out, ((0, 0), (0, axes - out.shape[1])))
    sign = np.sign(out[np.abs(out).argmax(axis=0), range(axes)])
    return out * np.where(sign == 0, 1, sign)


def _js_matrix(p: np.ndarray) -> np.ndarray:
    m = (p[:, None, :] + p[None, :, :]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.where(p[:, None, :] > 0, p[:, None, :] * np.log(p[:, None, :] / m), 0.0).sum(axis=2)
    return (half + half.T) / 2


def pcoa_2d(rows: DataFrame, batch: Sequence[str], key: str, distribution: str = "distribution") -> DataFrame:
    """batch..., key, x, y, label: classical scaling of Jensen-Shannon distances inside each batch."""
    batch = list(batch)
    labelled = rows.select(*batch, key, F.col(distribution).alias("_p"), X.topic_label(F.col(distribution)).alias("label"))
    types = dict(labelled.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in [*batch, key]] + ["x double", "y double", "label string"])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        at = classical_scaling(_js_matrix(np.stack(pdf["_p"].to_numpy()).astype(float)))
        return pdf.drop(columns="_p").assign(x=at[:, 0], y=at[:, 1])[[*batch, key, "x", "y", "label"]]

    return labelled.groupBy(*batch).applyInPandas(place, schema)


def topic_shares(doc_topics: DataFrame, length: str = "n_tokens") -> DataFrame:
    """topic, share: document shares weighted by document length. doc_topics: topic, theta, length."""
    sums = doc_topics.groupBy("topic").agg(F.sum(F.col("theta") * F.col(length)).alias("_w"))
    return sums.select("topic", (F.col("_w") / F.sum("_w").over(Window.partitionBy())).alias("share"))  # one row per topic


def topic_word_matrix(weights: DataFrame) -> DataFrame:
    """topic, term, phi: weights normalised so that each topic sums to 1. The sums have one row per topic."""
    sums = weights.groupBy("topic").agg(F.sum("weight").alias("_sum"))
    return weights.join(sums, "topic").select("topic", "term", (F.col("weight") / F.col("_sum")).alias("phi"))


def _with_marginals(phi: DataFrame, shares: DataFrame) -> DataFrame:
    """Joint and word probabilities; shares has one row per topic."""
    joint = phi.join(shares, "topic").withColumn("joint", F.col("phi") * F.col("share"))
    words = joint.groupBy("term").agg(F.sum("joint").alias("p_w"))
    return joint.join(words, "term")


def saliency(phi: DataFrame, shares: DataFrame) -> DataFrame:
    """term, saliency = p(w) * sum_t p(t|w) ln(p(t|w) / p(t))."""
    rows = _with_marginals(phi, shares).filter("joint > 0")
    posterior = F.col("joint") / F.col("p_w")
    gain = F.sum(posterior * F.log(posterior / F.col("share")))
    return rows.groupBy("term").agg((F.max("p_w") * gain).alias("saliency"))


def relevance(phi: DataFrame, shares: DataFrame, weight: float = 0.6, n: int = 30) -> DataFrame:
    """topic, place, term, relevance = w ln phi + (1-w) ln(phi / p(w)): the n most relevant terms per topic."""
    rows = _with_marginals(phi, shares).filter("phi > 0")
    score = weight * F.log("phi") + (1 - weight) * F.log(F.col("phi") / F.col("p_w"))
    order = Window.partitionBy("topic").orderBy(F.round("relevance", TIE_DIGITS).desc(), "term")
    scored = rows.select("topic", "term", score.alias("relevance"))
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def per_word_topics(phi: DataFrame, shares: DataFrame, minimum: float = 0.01) -> DataFrame:
    """term, place, topic, p: topics of each word by p(t|w), those below the minimum left out."""
    rows = _with_marginals(phi, shares).filter("joint > 0")
    shown = rows.select("term", "topic", (F.col("joint") / F.col("p_w")).alias("p")).filter(F.col("p") >= minimum)
    order = Window.partitionBy("term").orderBy(F.round("p", TIE_DIGITS).desc(), "topic")  # at most k rows per term
    return shown.withColumn("place", F.row_number().over(order))


def top_words(weights: DataFrame, n: int = 20) -> DataFrame:
    """topic, place, term, weight: the n heaviest terms per topic; each task keeps n before the shuffle."""
    order = Window.partitionBy("topic").orderBy(F.col("weight").desc(), "term")
    return weights.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
