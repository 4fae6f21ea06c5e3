"""Periodic runs of words: stretches in which a phrase is repeated several times without a break.

Each document is judged by itself, in Arrow pieces of about a megabyte that are worked on together. Longest common extensions (LCE) of two places
come from a difference cover: of every COVER places only those are sampled whose residue is in DIFFERENCES, and only their suffixes are
sorted. Any two places reach two samples after the same number of words, fewer than COVER, which are compared directly; what follows is a
minimum over the common prefixes of neighbouring samples, looked up in a sparse table. A run of period p and exponent x or more
covers a place of the grid 0, (x - 1) p, 2 (x - 1) p, ... together with the word p further on, so extending each grid place both
ways finds every run; the grids of all periods have about n log n / (x - 1) places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Words, blank_separated, pieces, spans_to_indices, text_buffer

# A set of residues that has every difference modulo COVER.
COVER = 21
DIFFERENCES = (3, 6, 7, 12, 14)
GRID_PLACES = 1 << 20  # grid places looked at together


def synchronised() -> np.ndarray:
    """[a, b]: the fewest words after which residues a and b are both sampled."""
    sampled = np.isin(np.arange(2 * COVER) % COVER, DIFFERENCES)
    steps = np.arange(COVER)
    both = sampled[steps[:, None, None] + steps] & sampled[steps[None, :, None] + steps]
    return both.argmax(axis=2)


class Extensions:
    """LCE of two places of one document in `symbols`, where documents end in a symbol of their own that belongs to them."""

    def __init__(self, symbols: np.ndarray, document: np.ndarray) -> None:
        self.symbols, self.after = symbols, synchronised()
        n = len(symbols)
        sampled = np.flatnonzero(np.isin(np.arange(n) % COVER, DIFFERENCES))
        rank = self._blocks(symbols, document, sampled)
        levels = [rank]
        reach = COVER
        while True:
            order = np.argsort(rank[sampled], kind="stable")
            sorted_ranks = rank[sampled][order]
            shared = np.zeros(len(sampled), dtype=bool)
            shared[1:] = sorted_ranks[1:] == sorted_ranks[:-1]
            shared[:-1] |= shared[1:]
            if not shared.any():
                break
            # Only groups that are still equal are told apart, by the ranks of what follows.
            at = sampled[order[shared]]
            group, following = rank[at], rank[np.minimum(at + reach, n)]
            inner = np.lexsort((following, group))
            at, group, following = at[inner], group[inner], following[inner]
            head = np.ones(len(at), dtype=bool)
            head[1:] = group[1:] != group[:-1]
            fresh = head.copy()
            fresh[1:] |= following[1:] != following[:-1]
            places = np.arange(len(at))
            rank = rank.copy()
            rank[at] = group + np.maximum.accumulate(np.where(fresh, places, 0)) - np.maximum.accumulate(np.where(head, places, 0))
            levels.append(rank)
            reach *= 2
        self.rank, self.suffix = rank, sampled[order]
        self.minima = self._sparse_table(self._common(levels))

    @staticmethod
    def _blocks(symbols: np.ndarray, document: np.ndarray, sampled: np.ndarray) -> np.ndarray:
        """For each sampled place the number of smaller blocks of COVER words (documents apart); one place more than symbols."""
        n = len(symbols)
        padded = np.concatenate([symbols.astype(np.uint64), np.zeros(COVER, dtype=np.uint64)])
        width = max(int(symbols.max(initial=0)).bit_length(), 1)
        together = max(64 // width, 1)
        keys = []
        for low in range(0, COVER, together):
            key = np.zeros(len(sampled), dtype=np.uint64)
            for t in range(low, min(low + together, COVER)):
                key = (key << np.uint64(width)) | padded[sampled + t]
            keys.append(key)
        keys = [document[sampled].astype(np.uint64), *keys]
        order = np.lexsort(keys[::-1])
        fresh = np.zeros(len(sampled), dtype=bool)
        for key in keys:
            fresh[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.full(n + 1, -1, dtype=np.int64)
        rank[sampled[order]] = np.maximum.accumulate(np.where(fresh, np.arange(len(sampled)), 0))
        return rank

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sorted suffix has in common with the one before it; 0 for the first of all."""
        n = len(self.symbols)
        common = np.zeros(len(self.suffix), dtype=np.int64)
        one, two = self.suffix[:-1].copy(), self.suffix[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            left, right = levels[k][np.minimum(one, n)], levels[k][np.minimum(two, n)]
            step = np.where((left == right) & (left >= 0), COVER << k, 0)
            one += step
            two += step
        open_ = np.arange(len(one))
        for _ in range(COVER):
            inside = open_[(one[open_] < n) & (two[open_] < n)]
            open_ = inside[self.symbols[one[inside]] == self.symbols[two[inside]]]
            if not len(open_):
                break
            one[open_] += 1
            two[open_] += 1
        common[1:] = two - self.suffix[1:]
        return common

    @staticmethod
    def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
        table = [values.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(values):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Equal words from each pair of places on; a pair is two different places of one document."""
        result = np.zeros(len(one), dtype=np.int64)
        steps = self.after[one % COVER, two % COVER]
        going = np.arange(len(one))
        reached = []
        for t in range(COVER):
            there = steps[going] == t
            reached.append(going[there])
            going = going[~there]
            going = going[self.symbols[one[going] + t] == self.symbols[two[going] + t]]
            if not len(going):
                break
            result[going] = t + 1
        reached = np.concatenate(reached)
        a, b = self.rank[one[reached] + steps[reached]], self.rank[two[reached] + steps[reached]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            some = level == k
            least = np.minimum(self.minima[k][low[some]], self.minima[k][high[some] - (1 << k) + 1])
            result[reached[some]] = steps[reached[some]] + least
        return result


def _grid(sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, period, place) in chunks: places 0, (exponent - 1) p, ... that have a word p further on, for periods p up to n / exponent."""
    periods = sizes // exponent
    for rows in np.array_split(np.arange(len(sizes)), max(1, int(periods.sum()) // GRID_PLACES)):
        row = np.repeat(rows, periods[rows])
        period = spans_to_indices(np.ones(len(rows), dtype=np.int64), periods[rows])
        step = (exponent - 1) * period
        count = (sizes[row] - 1 - period) // step + 1
        ends = np.cumsum(count)
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, GRID_PLACES)).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(row)]):
            some = slice(low, high)
            place = spans_to_indices(np.zeros(high - low, dtype=np.int64), count[some]) * np.repeat(step[some], count[some])
            yield np.repeat(row[some], count[some]), np.repeat(period[some], count[some]), place


def find_runs(words: np.ndarray, first: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """row, start, length, period of every run of the rows first[i]:first[i + 1] of `words`, sorted by row, start and period."""
    sizes = np.diff(first)
    rows = len(sizes)
    base = int(words.max(initial=-1)) + 1
    # An end symbol of its own before the first row and after each row.
    place = np.arange(len(words)) + np.repeat(np.arange(rows), sizes) + 1
    ends = np.concatenate([[0], first[1:] + np.arange(1, rows + 1)])
    symbols = np.empty(len(words) + rows + 1, dtype=np.int64)
    symbols[place] = words
    symbols[ends] = base + np.arange(rows + 1)
    row_after = np.repeat(np.arange(rows + 1), np.diff(np.concatenate([[-1], ends])))  # ends belong to the row before them
    row_before = np.repeat(np.arange(rows + 1), np.diff(np.concatenate([ends, [len(symbols)]])))  # or to the row after them
    origin = first[:-1] + np.arange(rows) + 1
    last = len(symbols) - 1
    forward = backward = None
    found = []
    for row, period, at in _grid(sizes, exponent):
        one = origin[row] + at
        equal = symbols[one] == symbols[one + period]
        row, period, one = row[equal], period[equal], one[equal]
        if not len(one):
            continue
        if forward is None:
            forward, backward = Extensions(symbols, row_after), Extensions(symbols[::-1].copy(), row_before[::-1].copy())
        right = forward(one, one + period)
        left = backward(last - (one + period - 1), last - (one - 1))
        length = left + period + right
        good = length >= np.maximum(least, exponent * period)
        found.append(np.stack([row[good], (one - origin[row] - left)[good], length[good], period[good]]))
    if not found:
        return np.zeros((4, 0), dtype=np.int64)
    row, start, length, period = np.concatenate(found, axis=1)
    # A stretch found with several periods has the least one as its own, of which the others are multiples.
    order = np.lexsort((period, length, start, row))
    row, start, length, period = row[order], start[order], length[order], period[order]
    own = np.ones(len(row), dtype=bool)
    own[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    row, start, length, period = row[own], start[own], length[own], period[own]
    order = np.lexsort((period, start, row))
    return np.stack([row[order], start[order], length[order], period[order]])


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", exponent: int = 4, least: int = 6
) -> DataFrame:
    """id, n_words, runs, collapsed_text: one row per row of `docs`.

    Words are what blanks separate. `runs` holds (start, length, period) of every stretch of at least `exponent` (2 or more) times its smallest period and
    at least `least` words that cannot be extended with that period, by start, then period. collapsed_text is the words joined by one
    space, without those that a run contains after its first period. Null, empty and blank texts have no words, no runs and the empty
    collapsed text. Rows are judged one by one: repeated rows and null ids are kept, equal texts get equal results, other columns
    are not read. A task holds one piece of about a megabyte, or one longer text: some 250 bytes a word of it.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    in_word = blank_separated()

    def judge(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(*text_buffer(piece.column("text")), in_word)
                offsets = np.concatenate([[0], np.cumsum(words.end - words.start)])
                letters = pa.py_buffer(words.data[in_word[words.data]].tobytes())
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets.astype(np.int64)), letters])
                numbers = values.dictionary_encode().indices.to_numpy().astype(np.int64)
                row, start, length, period = find_runs(numbers, words.first, exponent, least)

                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, words.first[row] + start + period, 1)
                np.add.at(change, words.first[row] + start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                stays = np.concatenate([[0], np.cumsum(kept)])[words.first]
                lists = pa.ListArray.from_arrays(pa.array(stays, pa.int32()), values.filter(pa.array(kept)).cast(pa.binary()))
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(piece.num_rows + 1)), pa.int32()), spans)
                collapsed = pc.binary_join(lists, b" ").cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(np.diff(words.first)), runs, collapsed], ["id", "n_words", "runs", "collapsed_text"]
                )

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    return source.mapInArrow(judge, schema).withColumnRenamed("id", id_column)
