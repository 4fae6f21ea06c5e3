"""Substring dedup by seed and extend.

Seeds are winnowed anchors: in each window of `length` words the k-word gram with the smallest hash, the leftmost of equals. The
choice depends on the window's words alone, so two equal windows always have equal anchors at the same offset. The windows that
share one occurrence of an anchor are neighbours and form a segment: the anchor extended left and right as far as it stays the
choice. There is one segment for about 14 words.

Segments with equal anchors meet by count, least and greatest hash, never as pairs: (1) an anchor seen once has no repeat;
(2) if all its segments are equal, they are repeated whole; (3) else the repeat ends inside, and the windows themselves are
counted. Neighbouring repeated windows make up the maximal repeats, which are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .textbytes import Hasher, Words, bitmap, blank_separated, may_contain, mix, pieces, signed, spans_to_indices, text_buffer

SEEDS = (7, 70)
ANCHOR_WORDS = 8


class Segments:
    """Runs of windows that share an anchor: anchor and segment hash, row, first window and number of windows."""

    def __init__(self, hashers: tuple[Hasher, Hasher], piece: pa.RecordBatch, length: int) -> None:
        self.words = words = Words(*text_buffer(piece.column("text")), blank_separated())
        self.length, self.other = length, hashers[1]
        gram = min(ANCHOR_WORDS, length)
        n = len(words)
        self.hash = hashers[0].words(words)
        at = np.arange(n)
        last = words.last()
        grams = hashers[0].ranges(self.hash, at, np.minimum(at + gram, n))
        best, span = at, 1  # best[i]: place of the least gram among `span` grams from i on
        slots = length - gram + 1
        while span < slots:
            step = min(span, slots - span)
            left, right = best[: n - step], best[step:]
            best = np.concatenate([np.where(grams[left] <= grams[right], left, right), best[n - step :]]) if n > step else best
            span += step
        window = np.flatnonzero(at + length <= last)
        anchor = best[window]
        fresh = np.ones(len(window), dtype=bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
        head = np.flatnonzero(fresh)
        self.first = window[head]
        self.count = np.diff(np.concatenate([head, [len(window)]]))
        self.row = words.row()[self.first] if n else self.first
        self.anchor = grams[anchor[head]]
        self.second = mix(self.hash + np.uint64(SEEDS[1])) if n else self.hash
        self.segment = self.other.ranges(self.second, self.first, self.first + self.count + length - 1)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, hash) of each window of the chosen segments."""
        start = spans_to_indices(self.first[chosen], self.count[chosen])
        return np.repeat(chosen, self.count[chosen]), self.other.ranges(self.second, start, start + self.length)


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, Segments]]:
    hashers = Hasher(SEEDS[0]), Hasher(SEEDS[1])
    for batch in batches:
        for piece in pieces(batch, "text"):
            yield piece, Segments(hashers, piece, length)


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 35
) -> DataFrame:
    """id, n_words, n_removed, kept_text, kept_sha256: one row per row of `docs`.

    A word is removed if a window of `length` words that covers it also starts elsewhere in the table. Every copy goes, the
    first one too; windows are judged on the input. Null and empty texts have no words and keep the empty text. Repeated rows are copies
    of each other. Rows with equal id and text are treated alike; null ids are allowed. Other columns are not read.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("h", F.xxhash64("id", "text"))

    def anchors(batches):
        for _, found in _scan(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(signed(found.anchor)), pa.array(signed(found.segment))], ["anchor", "segment"])

    seen = source.select("text").mapInArrow(anchors, "anchor long, segment long").groupBy("anchor")
    seen = seen.agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high")).filter("n > 1")
    seen = materialize(seen.select("anchor", (F.col("low") == F.col("high")).alias("whole")), "anchors")
    flags, part_flags = bitmap(seen, "anchor", 26), bitmap(seen.filter("not whole"), "anchor", 26)

    def occurrences(batches):
        for piece, found in _scan(batches, length):
            hit = np.flatnonzero(may_contain(flags, found.anchor))
            part = may_contain(part_flags, found.anchor[hit])
            sizes = np.where(part, found.count[hit], 0)
            _, hashes = found.windows(hit[part])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            row = found.row[hit]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("h").take(pa.array(row)),
                    pa.array(signed(found.anchor[hit])),
                    pa.array(found.first[hit] - found.words.first[row]),
                    pa.array(found.count[hit]),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(hashes))),
                ],
                ["h", "anchor", "first", "count", "windows"],
            )

    found = source.select("h", "text").mapInArrow(occurrences, "h long, anchor long, first long, count long, windows array<long>")
    found = materialize(found.join(seen, "anchor"), "occurrences")
    whole = found.filter("whole").select("h", "first", "count")
    windows = found.filter("not whole").select("h", "anchor", "first", F.posexplode("windows").alias("at", "window"))
    windows = windows.select("h", "anchor", "window", (F.col("first") + F.col("at")).alias("first"))
    # Written first, so that both sides of the join are shuffled for it and a hot window can be split.
    again = materialize(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "windows")
    single = windows.join(again, ["anchor", "window"]).select("h", "first", F.lit(1).cast("long").alias("count"))
    cuts = whole.union(single).groupBy("h").agg(F.array_sort(F.collect_set(F.struct("first", "count"))).alias("cuts"))

    id_type = dict(docs.dtypes)[id_column]

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(*text_buffer(piece.column("text")), blank_separated())
                n = np.diff(words.first)
                change = np.zeros(len(words) + 1, dtype=np.int64)
                lists = piece.column("cuts")
                spans = lists.flatten()
                where = np.repeat(np.arange(piece.num_rows), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                start = spans.field("first").to_numpy(zero_copy_only=False).astype(np.int64) + words.first[where]
                end = start + spans.field("count").to_numpy(zero_copy_only=False).astype(np.int64) + length - 1
                np.add.at(change, start, 1)
                np.add.at(change, end, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                removed = removed[words.first[1:]] - removed[words.first[:-1]]
                kept = []
                for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    stay = np.flatnonzero(~gone[low:high]) + low
                    kept.append(b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist())))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"),
                        pa.array(n),
                        pa.array(removed),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                    ],
                    ["id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    joined = source.join(cuts, "h", "left").select("id", "text", "cuts")
    schema = f"id {id_type}, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_column)
