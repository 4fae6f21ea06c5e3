"""Groups spelling variants: words one edit apart, found by an index of grams of variable length.

A gram at a place is as long as it has to be to tell words apart: it starts with QMIN characters and grows while it is among the frequent grams, up to QMAX
characters or the word's end. Frequent are grams with more than 1 / FREQUENT of all places of their length, and more than LIST: at most FREQUENT of each
length, a proven bound for what tasks are given, however many words there are. As a gram depends on its own characters only, one
edit changes the grams that cover it and no others. The most grams that any one edit can change is the word's bound; of its grams, taken
rarest first, one more than the bound are filed, so that two near words are in one list at least, at places that fit.

Lists are kept by gram, place and length of the word. Lists of more than LIST words are not paired: their words go by their deletions
instead (two near words share the word with one character left out), which finds the same pairs at a cost that grows with the words only.
Every pair is verified by its characters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .textbytes import Hasher, bitmap, may_contain, mix, signed

QMIN, QMAX = 4, 6
FREQUENT = 1 << 16
LIST = 64
LONG_WORD = 64
MOST_BITS = 28  # of the filter over list keys: 32 MB
SEED = 13
END = np.uint64(0x110000)  # beyond every code point


class Grams:
    """Words of a batch as code points, each followed by END, and hashes of the grams at each place."""

    def __init__(self, hasher: Hasher, words: pa.Array) -> None:
        texts = words.to_pylist()
        self.sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(codes)) - first[self.row]
        self.rest = self.sizes[self.row] - self.place  # characters from here to the word's end
        self.at = np.arange(len(codes)) + self.row
        self.values = np.full(len(codes) + len(texts), END)
        self.values[self.at] = codes
        self.values = mix(self.values + np.uint64(SEED))
        self.start, self.hasher = first + np.arange(len(texts)), hasher

    def hashes(self, length: np.ndarray | int) -> np.ndarray:
        """Hash of `length` symbols from each place, END included; no more than there are."""
        return self.hasher.ranges(self.values, self.at, self.at + np.minimum(length, self.rest + 1))

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash): each word itself and with each one of its characters left out."""
        n = len(self.values)
        self.hasher._grow(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values * self.hasher.up[:n], out=total[1:])
        low, high = self.start[self.row], self.start[self.row] + self.sizes[self.row]
        behind = (total[high] - total[self.at + 1]) * np.uint64(self.hasher.inverse)
        without = (total[self.at] - total[low] + behind) * self.hasher.down[low]
        whole = (total[self.start + self.sizes] - total[self.start]) * self.hasher.down[self.start]
        rows = np.arange(len(self.sizes))
        return np.concatenate([rows, self.row]), mix(np.concatenate([whole, without]))


def one_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of different words one edit apart: what both have in front and behind leaves one character at most."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            short, long = (np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for w in sorted((a, b), key=len))
            n = len(short)
            front = int(np.argmin(np.append(short == long[:n], False)))
            keep.append(len(long) - n <= 1 and bool((short[front + (n == len(long)) :] == long[front + 1 :]).all()))
        yield batch.filter(pa.array(keep, pa.bool_()))


def _frequency(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """How often each gram occurs if it is frequent, else 0."""
    grams, counts = table
    if not len(grams):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
    return np.where(grams[at] == hashes, counts[at], 0)


def filed_grams(grams: Grams, frequent: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the grams by which each word is filed."""
    length = np.minimum(QMIN, grams.rest + 1)
    hashes = grams.hashes(QMIN)
    often = _frequency(frequent[QMIN], hashes)
    for q in range(QMIN + 1, QMAX + 1):
        grows = np.flatnonzero((often > 0) & (length == q - 1) & (grams.rest >= q - 1))
        if not len(grows):
            break
        length[grows] = q
        hashes[grows] = grams.hasher.ranges(grams.values, grams.at[grows], grams.at[grows] + q)
        often[grows] = _frequency(frequent[q], hashes[grows])
    # The bound: the most grams that cover one character.
    covering = np.zeros(len(length), dtype=np.int64)
    for back in range(QMAX):
        some = np.flatnonzero(grams.place >= back)
        covering[some] += length[some - back] > back
    bound = np.zeros(len(grams.sizes), dtype=np.int64)
    np.maximum.at(bound, grams.row, covering)
    order = np.lexsort((hashes, often, grams.row))
    rank = grams.place  # in `order`, words keep their places: the k-th of a word is k
    ends = np.flatnonzero(rank == np.minimum(bound, grams.sizes - 1)[grams.row])
    last_often, last_hash = often[order[ends]], hashes[order[ends]]
    row = np.searchsorted(grams.row[ends], grams.row)  # words without characters have no last gram
    # All places of the last gram count, so that equal grams need no order among themselves.
    taken = (often < last_often[row]) | ((often == last_often[row]) & (hashes <= last_hash[row]))
    return grams.row[taken], grams.place[taken], hashes[taken]


def _list_key(hashes: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _frequent_grams(words: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the hashes of the frequent grams, sorted, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            grams = Grams(hasher, batch.column(0))
            for q in range(QMIN, QMAX + 1):
                kinds, counts = np.unique(grams.hashes(q)[grams.rest >= q - 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), q)), pa.array(signed(kinds)), pa.array(counts)], ["q", "gram", "n"])

    counted = words.select("word").mapInArrow(count, "q long, gram long, n long").groupBy("q", "gram").agg(F.sum("n").alias("n"))
    lengths = range(QMIN, QMAX + 1)
    places = words.agg(*[F.sum(F.greatest(F.length("word") - (q - 2), F.lit(0))) for q in lengths]).first()
    # At most FREQUENT rows of each length: each has more than 1 / FREQUENT of all its places.
    least = {q: max(LIST, (n or 0) // FREQUENT) for q, n in zip(lengths, places)}
    often = F.lit(False)
    for q, n in least.items():
        often = often | ((F.col("q") == q) & (F.col("n") > n))
    table = counted.filter(often).toArrow()
    held, grams, counts = (table.column(c).to_numpy().astype(np.int64) for c in ("q", "gram", "n"))
    grams = grams.view(np.uint64)
    found = {}
    for q in lengths:
        some = np.flatnonzero(held == q)
        some = some[np.argsort(grams[some])]
        found[q] = grams[some], counts[some]
    return found


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: each pair of different words one edit apart, once. `words` has distinct words and their counts n."""
    frequent = _frequent_grams(words)
    schema = "key long, word string, n long, own boolean"

    def keys_of(grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(row, key, own): a word's own lists, and those of words shorter by one, where a gram stands there or one place earlier."""
        row, place, hashes = filed_grams(grams, frequent)
        size = grams.sizes[row]
        yield row, _list_key(hashes, place, size), True
        for shift in (0, 1):
            some = place >= shift
            yield row[some], _list_key(hashes[some], place[some] - shift, size[some] - 1), False

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            for _, key, own in keys_of(Grams(hasher, batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(np.full(len(key), own))], ["key", "own"])

    lists = words.select("word").mapInArrow(count, "key long, own boolean").groupBy("key")
    lists = lists.agg(F.count("*").alias("size"), F.max("own").alias("any_own")).filter("size > 1 and any_own")
    lists = materialize(lists.select("key", (F.col("size") > LIST).alias("long")), "lists")
    # Flags in proportion to the lists let through few words that stand alone; what passes is joined exactly.
    flags = bitmap(lists, "key", min(max(lists.count() * 8, 1 << 16).bit_length(), MOST_BITS))

    def rows_of(batch: pa.RecordBatch, row: np.ndarray, key: np.ndarray, own: bool) -> pa.RecordBatch:
        taken = pa.array(row)
        columns = [pa.array(signed(key)), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(np.full(len(row), own))]
        return pa.RecordBatch.from_arrays(columns, ["key", "word", "n", "own"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            for row, key, own in keys_of(Grams(hasher, batch.column(0))):
                some = may_contain(flags, key)
                yield rows_of(batch, row[some], key[some], own)

    filed = words.select("word", "n").mapInArrow(file, schema)
    short = filed.join(lists.filter("not long").select("key"), "key").groupBy("key")
    short = short.agg(F.collect_list(F.struct("word", "n", "own")).alias("members"))  # LIST at most
    pairs = short.select(F.explode(F.filter("members", lambda m: m["own"])).alias("x"), "members").select("x", F.explode("members").alias("y"))
    pairs = pairs.filter("x.word < y.word or (not y.own and x.word <> y.word)")
    pairs = pairs.select(F.col("x.word").alias("a"), F.col("x.n").alias("na"), F.col("y.word").alias("b"), F.col("y.n").alias("nb"))

    # `own` is read here too, so that both uses of the filed words are one shuffle.
    in_long = filed.join(lists.filter("long").select("key"), "key").groupBy("word", "n").agg(F.max("own").alias("own")).select("word", "n")
    # Words of QMAX characters or fewer may have no gram that an edit leaves alone.
    if (words.agg(F.min(F.length("word"))).first()[0] or 0) <= QMAX:
        in_long = in_long.union(words.filter(F.length("word") <= QMAX + 1).select("word", "n")).distinct()
    in_long = materialize(in_long, "in_long")

    def count_deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(Grams(hasher, batch.column(0)).deletions()[1]))], ["key"])

    shared = in_long.select("word").mapInArrow(count_deletions, "key long").groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(shared.select("key"), "deletions")
    twice = bitmap(shared, "key", min(max(shared.count() * 8, 1 << 16).bit_length(), MOST_BITS))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED)
        for batch in batches:
            row, key = Grams(hasher, batch.column(0)).deletions()
            some = may_contain(twice, key)
            yield rows_of(batch, row[some], key[some], True)

    without = in_long.mapInArrow(delete, schema).select("key", "word", "n")
    one = without.select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    two = without.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    pairs = pairs.union(one.join(two, "key").filter("a < b").drop("key"))
    # Spark's edit distance costs the square of the length: long words, of which there are few, are compared from both ends instead.
    long_pair = F.length("a") > LONG_WORD
    near = pairs.filter(~long_pair).filter(F.levenshtein("a", "b", 1) == 1).union(pairs.filter(long_pair).distinct().mapInArrow(one_edit, pairs.schema))
    ordered = F.col("a") < F.col("b")
    return near.select(
        F.least("a", "b").alias("a"),
        F.when(ordered, F.col("na")).otherwise(F.col("nb")).alias("na"),
        F.greatest("a", "b").alias("b"),
        F.when(ordered, F.col("nb")).otherwise(F.col("na")).alias("nb"),
    ).distinct()


def spelling_variants(words: DataFrame, word_column: str = "word", count_column: str = "n", times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each distinct word.

    Rows of equal words are added up; null words and null counts are left out. n_near counts the words that differ from this by exactly one
    inserted, deleted or replaced character. form is the one of them with the largest count (ties: the smallest word) if that is at
    least `times` (2 or more) the word's own, else null. root is the end of the chain of forms: each step multiplies the count, so the
    chain is as long as the logarithm of the largest count at most. The empty word is a word; an empty table gives an empty table.
    Characters are code points. Other columns are not read. A task holds one Arrow batch of words with their grams.
    """
    if times < 2:
        raise ValueError("a form is at least twice as frequent as its variants")
    read = words.select(F.col(word_column).alias("word"), F.col(count_column).cast("long").alias("n")).filter("word is not null and n is not null")
    words = materialize(read.groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("word")).alias("other"))
    both = both.union(pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("word")).alias("other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    enough = -F.col("best.less") >= F.col("n") * times
    near = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    near = materialize(near, "forms")
    steps = near.filter("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to"))
    roots = near.withColumn("root", F.coalesce("form", "word"))
    largest = words.agg(F.max("n")).first()[0] or 1
    for _ in range(int(math.log(max(largest, 1), times))):
        roots = roots.join(steps, F.col("root") == F.col("from"), "left").withColumn("root", F.coalesce("to", "root")).drop("from", "to")
    return roots.select("word", "form", "root", "n", "n_near", "form_n")
