"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage is encoded by its hashed words and by figures of its own (characters, repeats, line ends);
a gated attention, tanh(V h) * sigmoid(U h), weighs the passages; the weighted sum of their hidden vectors is scored. All weights
are learned from document labels. Training uses a bounded sample, TRAINING_DOCS labelled documents and of each TRAINING_PASSAGES passages, evenly
spread over the text; scoring covers all passages of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Hasher, Words, ascii_lower, blank_separated, pieces, running, text_buffer

SEED = 9
TRAINING_DOCS = 3000  # bound of the sample: labelled documents with the smallest hash of their id
TRAINING_PASSAGES = 128  # bound of a labelled document's passages
PASSAGE_WORDS = 64
SLOTS = 48
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY = 60, 0.01, 1e-4
FIGURES = 12


def passages(hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage vectors, first passage of each row); a row without words has one passage of zeros."""
    words = Words(data, offsets, blank_separated())
    rows, count = len(offsets) - 1, np.diff(words.first)
    number = np.maximum((count + PASSAGE_WORDS - 1) // PASSAGE_WORDS, 1)
    first = np.concatenate([[0], np.cumsum(number)])
    out = np.zeros((int(first[-1]), SLOTS + FIGURES))
    if not len(words):
        return out, first
    row = words.row()
    within = np.arange(len(words)) - words.first[row]
    passage = first[row] + within // PASSAGE_WORDS
    hashes = hasher.ranges(hasher.bytes[ascii_lower()[data]], words.start, words.end)
    slot = (hashes % np.uint64(SLOTS)).astype(np.int64)
    size = np.bincount(passage, minlength=len(out)).astype(float)
    some = np.maximum(size, 1)
    bag = np.bincount(passage * SLOTS + slot, minlength=len(out) * SLOTS).reshape(len(out), SLOTS)
    out[:, :SLOTS] = np.sqrt(bag / some[:, None])

    def share(flag: np.ndarray) -> np.ndarray:
        """Bytes with a flag for each passage and word."""
        total = running(flag.astype(np.uint64)).astype(np.int64)
        return np.bincount(passage, weights=total[words.end] - total[words.start], minlength=len(out)) / some

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    kinds = [np.isin(data, np.frombuffer(x, np.uint8)) for x in (b"#*$%&<>", b"|", b"!", b".,;:?", b"0123456789")]
    order = np.lexsort((hashes, passage))
    repeat = np.zeros(len(words), dtype=bool)
    repeat[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
    figures = [share(k) for k in kinds] + [share(upper), share(lower), share((data & 0xC0) != 0x80)]
    figures += [np.bincount(passage, weights=repeat, minlength=len(out)) / some, np.log1p(size)]
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    figures += [np.bincount(passage, weights=same, minlength=len(out)) / some, np.log1p(np.repeat(count, number).astype(float))]
    out[:, SLOTS:] = np.stack(figures, axis=1)
    return out, first


class AttentionModel:
    """Passage encoder, gated attention over passages, and a logistic score of the weighted sum."""

    def __init__(self, width: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = {
            "W": rng.normal(size=(width, HIDDEN)) / np.sqrt(width), "b": np.zeros(HIDDEN), "V": rng.normal(size=(HIDDEN, GATE)) / np.sqrt(HIDDEN),
            "U": rng.normal(size=(HIDDEN, GATE)) / np.sqrt(HIDDEN), "w": rng.normal(size=GATE) / np.sqrt(GATE), "c": rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, start = self.p, first[:-1]
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logit = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(start)), np.diff(first))
        e = np.exp(logit - np.maximum.reduceat(logit, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        pooled = np.add.reduceat(a[:, None] * h, start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(pooled @ p["c"] + p["d"], -30, 30)))
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "pooled": pooled, "y": y, "bag": bag}

    def gradients(self, f: dict[str, np.ndarray], label: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, f["bag"]
        out = (f["y"] - label) / len(label)
        pooled = out[:, None] * p["c"]
        near = (pooled[bag] * f["h"]).sum(axis=1)
        logit = f["a"] * (near - np.add.reduceat(f["a"] * near, first[:-1])[bag])
        t = logit[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        s = logit[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        h = (f["a"][:, None] * pooled[bag] + t @ p["V"].T + s @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["z"].T @ h, "b": h.sum(axis=0), "V": f["h"].T @ t, "U": f["h"].T @ s, "w": (f["t"] * f["s"]).T @ logit,
            "c": f["pooled"].T @ out, "d": np.array([out.sum()]),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int) -> None:
        """Adam over shuffled batches of bags."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-6
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 128):
                batch = order[at : at + 128]
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in batch])])
                g = self.gradients(self.forward(np.concatenate([bags[i] for i in batch]), first), labels[batch], first)
                step += 1
                for k in self.p:
                    grad = g[k] + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> AttentionModel | None:
    """A model from a bounded sample, or None if no labelled document is found.

    An id with several labels has the greatest. Repeated rows count once; of an id with several texts each counts, within the bound.
    """
    marked = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    marked = marked.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("label"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(TRAINING_DOCS)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "id")
    once = texts.withColumn("order", F.xxhash64("id", "text")).dropDuplicates(["id", "order"])
    texts = once.orderBy("order", "id").limit(TRAINING_DOCS).select("id", "text", "label")

    def spread(first: int, last: int) -> np.ndarray:
        return np.unique(np.linspace(first, last - 1, min(last - first, TRAINING_PASSAGES)).round().astype(np.int64))

    def encode(batches):
        hasher = Hasher(SEED)
        for batch in batches:
            for piece in pieces(batch, "text"):
                x, first = passages(hasher, *text_buffer(piece.column("text")))
                bags = [x[spread(a, b)].astype("<f4").tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label").cast(pa.int64()), pa.array(bags, pa.binary())], ["id", "label", "bag"])

    id_type = dict(docs.dtypes)[id_column]
    rows = texts.mapInArrow(encode, f"id {id_type}, label long, bag binary").collect()
    rows = sorted({(r.id, r.label, bytes(r.bag)) for r in rows})
    if not rows:
        return None
    bags = [np.frombuffer(b, "<f4").reshape(-1, SLOTS + FIGURES).astype(float) for _, _, b in rows]
    model = AttentionModel(SLOTS + FIGURES, SEED)
    model.fit(bags, np.array([float(label > 0) for _, label, _ in rows]), SEED)
    return model


def score(docs: DataFrame, model: AttentionModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score (0 to 1), top_passage (place of the passage with most weight): one row per row of `docs`.

    Null and empty texts are one empty passage and are scored like any other. Without a model every score is 0.5. Only the text is used,
    so equal texts have equal scores; other columns are not read.
    """
    id_type = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]):
        hasher = Hasher(SEED)
        for batch in batches:
            for piece in pieces(batch, "text"):
                x, first = passages(hasher, *text_buffer(piece.column("text")))
                if model is None:
                    y, top = np.full(piece.num_rows, 0.5), np.zeros(piece.num_rows, dtype=np.int64)
                else:
                    f = model.forward(x.astype("<f4").astype(float), first)
                    y = f["y"]
                    best = np.lexsort((-np.arange(len(f["a"])), f["a"], f["bag"]))[first[1:] - 1]
                    top = best - first[:-1]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(y), pa.array(top)], ["id", "score", "top_passage"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id {id_type}, score double, top_passage long").withColumnRenamed("id", id_column)
