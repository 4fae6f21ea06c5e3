"""Benchmark decontamination by a prefix-filtered set join.

Each item gives windows of `window` consecutive words (one window if it has fewer). A window is a set of word shingles at
known offsets. To contain it whole, a document must have every shingle, so the prefix that must be joined is one shingle:
the rarest, by its count in the documents. A shingle that no document has rules its window out. A joined pair must fit by position
(the window starts at or after the document's first word) and by length (it ends at or before the last), and then its
words are compared with the item-sized window of the document around the shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .textbytes import Hasher, Words, alphanumeric, ascii_lower, bitmap, may_contain, pieces, signed, text_buffer

SEED = 1
SHINGLE = 5


def _words(piece: pa.RecordBatch) -> Words:
    data, offsets = text_buffer(piece.column("text"))
    return Words(ascii_lower()[data], offsets, alphanumeric())


def _shingles(hasher: Hasher, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of `width` words within a row."""
    at = np.arange(len(words))
    start = np.flatnonzero(at + width <= words.last())
    return start, hasher.ranges(hasher.words(words), start, start + width)


def item_windows(items: DataFrame, item_column: str, text_column: str, window: int) -> DataFrame:
    """item, size, words (joined by one blank), shingles: the distinct windows of each item."""
    item_type = dict(items.dtypes)[item_column]

    def cut(batches):
        hasher = Hasher(SEED)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = _words(piece)
                hashes = hasher.words(words)
                out = []
                for i, item in enumerate(piece.column("item").to_pylist()):
                    low, high = int(words.first[i]), int(words.first[i + 1])
                    size = min(window, high - low)
                    width = min(SHINGLE, size)
                    for start in range(low, high - size + 1) if size else ():
                        at = np.arange(start, start + size - width + 1)
                        out.append((item, size, words.joined(start, start + size), signed(hasher.ranges(hashes, at, at + width)).tolist()))
                columns = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], piece.schema.field("item").type),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.binary()).cast(pa.string()),
                        pa.array(columns[3], pa.list_(pa.int64())),
                    ],
                    ["item", "size", "words", "shingles"],
                )

    named = items.select(F.col(item_column).alias("item"), F.col(text_column).alias("text"))
    cut_up = named.mapInArrow(cut, f"item {item_type}, size long, words string, shingles array<long>")
    return cut_up.dropDuplicates(["item", "words"])


def contaminated_words(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
    window: int = 13,
) -> DataFrame:
    """id, _text_hash, n_words, n_hit, items (sorted strings of the ids), spans: one row per row of `docs`.

    Words are runs of letters and digits, A-Z in lower case. spans are the hit word ranges as (first word, words); they may overlap. Null and
    empty texts have no words and no hits; items without words, and null items, have no windows; repeated item rows count
    once; an item with a null id is matched, and left out of `items`. Rows with equal id and text are treated alike.
    An empty table on either side gives no hits. Other columns are not read.
    """
    windows = materialize(item_windows(items, item_column, text_column, window), "windows")
    exploded = windows.select("size", "words", F.posexplode("shingles").alias("at", "shingle")).distinct()
    exploded = exploded.select(F.least("size", F.lit(SHINGLE)).alias("width"), "*")
    flags = bitmap(exploded, "shingle")
    widths = sorted(r.width for r in exploded.select("width").distinct().collect())  # one to five
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = dict(source.dtypes)["id"]

    def count(batches):
        hasher = Hasher(SEED)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = _words(piece)
                for width in widths:
                    _, hashes = _shingles(hasher, words, width)
                    value, n = np.unique(hashes[may_contain(flags, hashes)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n)], ["shingle", "n"])

    counts = source.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    ranked = exploded.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    prefix = ranked.groupBy("words", "size").agg(F.min(F.struct("n", "shingle", "at")).alias("rarest"))
    prefix = prefix.filter("rarest.n > 0").select("words", "size", "rarest.shingle", F.col("rarest.at").cast("long").alias("at"))
    prefix = materialize(prefix, "prefix")
    prefix_flags = bitmap(prefix, "shingle")

    def candidates(batches):
        hasher = Hasher(SEED)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = _words(piece)
                n = np.diff(words.first)
                ids, keys = piece.column("id"), piece.column("h")
                blank = pa.nulls(len(n), pa.int64())
                names = ["id", "h", "n_words", "shingle", "place", "context_from", "context"]
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n), blank, blank, blank, pa.nulls(len(n), pa.string())], names)
                rows = words.row()
                for width in widths:
                    start, hashes = _shingles(hasher, words, width)
                    hit = may_contain(prefix_flags, hashes)
                    start, hashes = start[hit], hashes[hit]
                    row = rows[start]
                    low = np.maximum(start - window + width, words.first[row])
                    high = np.minimum(start + window, words.first[row + 1])
                    context = [words.joined(a, b) for a, b in zip(low.tolist(), high.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(row)),
                            keys.take(pa.array(row)),
                            pa.array(n[row]),
                            pa.array(signed(hashes)),
                            pa.array(start - words.first[row]),
                            pa.array(low - words.first[row]),
                            pa.array(context, pa.binary()).cast(pa.string()),
                        ],
                        names,
                    )

    schema = f"id {id_type}, h long, n_words long, shingle long, place long, context_from long, context string"
    scanned = source.withColumn("h", F.xxhash64("id", "text")).select("id", "h", "text").mapInArrow(candidates, schema)
    scanned = materialize(scanned, "scanned")
    rows = scanned.filter("shingle is null").select("id", "h", "n_words")
    near = scanned.filter("shingle is not null").distinct()
    first = F.col("place") - F.col("at")
    around = F.slice(F.split("context", " "), (first - F.col("context_from") + 1).cast("int"), F.col("size").cast("int"))
    fits = near.join(prefix, "shingle").filter((first >= F.col("context_from")) & (first + F.col("size") <= F.col("n_words")))
    hits = fits.filter(F.array_join(around, " ") == F.col("words")).select("h", "words", first.alias("first"), "size")
    hits = hits.join(windows.select("words", F.col("item").cast("string").alias("item")), "words")
    per_row = hits.groupBy("h").agg(
        F.array_sort(F.collect_set(F.struct("first", "size"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def cover(seen, span):
        end = span["first"] + span["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(span["first"], seen["upto"]))
        return F.struct((seen["n"] + fresh).alias("n"), F.greatest(seen["upto"], end).alias("upto"))

    n_hit = F.coalesce(F.aggregate("spans", nothing, cover)["n"], F.lit(0).cast("long"))
    joined = rows.join(per_row, "h", "left")
    return joined.select(
        F.col("id").alias(id_column),
        F.col("h").alias("_text_hash"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:bigint,size:bigint>>")).alias("spans"),
    )
