"""Words and word windows of whole Arrow batches as NumPy arrays.

A string column of an Arrow batch is one run of UTF-8 bytes. The word classes of the operators are sets of ASCII
bytes (every byte of a longer character counts as a letter), so words are found by one table look-up over the bytes and
hashed by prefix sums, without a Python object for each word. Batches are cut into pieces of about a megabyte of text;
a longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20


def byte_table(not_in_words: Sequence[tuple[int, int]]) -> np.ndarray:
    """256 flags: True where the byte belongs to a word. Ranges are inclusive."""
    table = np.ones(256, dtype=bool)
    for low, high in not_in_words:
        table[low : high + 1] = False
    return table


def blank_separated() -> np.ndarray:
    """Word bytes of `[^\\x20\\x09-\\x0D]+`."""
    return byte_table([(0x09, 0x0D), (0x20, 0x20)])


def alphanumeric() -> np.ndarray:
    """Word bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, after lower-casing A-Z."""
    return byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them; null is empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Words:
    """Words of the rows of a piece: byte range of each word, and `first[i]:first[i + 1]` for row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = in_word[data]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[cut] = False
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def last(self) -> np.ndarray:
        """Index one beyond the last word of each word's row."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def joined(self, low: int, high: int) -> bytes:
        """Words low:high joined by one space."""
        data = self.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.start[low:high].tolist(), self.end[low:high].tolist()))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(x: np.ndarray) -> np.ndarray:
    """0, x[0], x[0] + x[1], ... modulo 2^64."""
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=total[1:])
    return total


class Hasher:
    """64-bit hashes of byte and word ranges by prefix sums of a polynomial modulo 2^64, scrambled at the end."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.base, self.inverse = base % (1 << 64), pow(base, -1, 1 << 64)
        self.size = 0
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            for name, value in (("up", self.base), ("down", self.inverse)):
                steps = np.full(self.size, value, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair; equal sequences have equal hashes wherever they stand."""
        self._grow(len(values) + 1)
        total = running(values * self.up[: len(values)])
        length = (end - start).astype(np.uint64)
        return mix((total[end] - total[start]) * self.down[start] + length * np.uint64(0x9E3779B97F4A7C15))

    def words(self, words: Words) -> np.ndarray:
        return self.ranges(self.bytes[words.data], words.start, words.end)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as the signed numbers that Spark has."""
    return x.astype(np.uint64, copy=False).view(np.int64)


def bitmap(df: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A filter over the hashes in `column`: one of 2^bits flags is set for the low bits of each.

    Built by Spark's bitmap aggregates in blocks of 4 kB; the driver gets 2^bits / 8 bytes at most (2 MB for 24), whatever the
    table's size. A fuller filter lets more pass; it never loses a hash, and what passes is joined exactly afterwards.
    """
    value = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)
    blocks = (
        df.select(value.alias("v"))
        .groupBy(F.bitmap_bucket_number("v").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("flags"))
    )
    flags = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in blocks.collect():
        part = np.frombuffer(bytes(row.flags), dtype=np.uint8)
        at = (row.block - 1) * 4096
        flags[at : at + len(part)] = part[: len(flags) - at]
    return flags


HELD_KEYS = 1 << 22  # keys that a task sorts at once
CHUNK = 16  # keys of one chunk of the key space differ in so many bits


def repeated_flags(source: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], space: int, bits: int) -> np.ndarray:
    """A filter like that of `bitmap`, with the flags of all keys that `keys_of` yields twice or more.

    Keys are compared by their low `space` bits: a key found once may be taken for a repeated one if that space is full, never the other way
    round. Tasks send the places that are set in each chunk of the space, two bytes a key, and a task that merges holds the flags of one chunk. The driver
    gets 2^bits / 8 bytes.
    """
    classes = (1 << (bits - CHUNK)) - 1

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        once, again = keys[fresh], np.unique(keys[~fresh])
        blocks, heads = np.unique(once >> np.uint64(CHUNK), return_index=True)

        def places(values: np.ndarray, starts: np.ndarray) -> pa.Array:
            offsets = np.append(starts, len(values)).astype(np.int32) * 2
            return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer((values & np.uint64(0xFFFF)).astype("<u2").tobytes())])

        found = np.searchsorted(again >> np.uint64(CHUNK), blocks)
        columns = [pa.array((blocks & np.uint64(classes)).astype(np.int64)), pa.array(blocks.astype(np.int64)), places(once, heads), places(again, found)]
        return pa.RecordBatch.from_arrays(columns, ["class", "block", "once", "again"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for keys in keys_of(batches):
            held.append(keys & np.uint64((1 << space) - 1))
            total += len(keys)
            if total >= HELD_KEYS:
                yield packed(held)
                held, total = [], 0
        if total:
            yield packed(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block = None, None
        seen, twice = np.zeros(1 << CHUNK, dtype=bool), np.zeros(1 << CHUNK, dtype=bool)

        def done() -> pa.RecordBatch:
            flags = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([flags], pa.binary())], ["class", "flags"])

        for batch in batches:
            for own, b, once, again in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != here and here is not None:
                    yield done()
                    twice[:] = False
                if b != block:
                    seen[:] = False
                here, block = own, b
                at = np.frombuffer(once, dtype="<u2")
                twice[at[seen[at]]] = True
                seen[at] = True
                twice[np.frombuffer(again, dtype="<u2")] = True
        if here is not None:
            yield done()

    parts = source.mapInArrow(count, "class long, block long, once binary, again binary")
    merged = parts.repartition("class").sortWithinPartitions("class", "block").mapInArrow(merge, "class long, flags binary")
    flags = np.zeros((1 << bits) // 8, dtype=np.uint8)
    size = (1 << CHUNK) // 8
    for row in merged.collect():
        flags[row["class"] * size : (row["class"] + 1) * size] = np.frombuffer(bytes(row.flags), dtype=np.uint8)
    return flags


def may_contain(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes.astype(np.uint64, copy=False) & np.uint64(len(flags) * 8 - 1)
    return (flags[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def spans_to_indices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... start[0]+length[0]-1, start[1], ... as one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length, length) + np.repeat(start, length)
