"""N-gram Jaccard join by the pigeonhole over a partitioned universe.

Sets of word shingles are put into size bands. For a band with largest size U, two linked sets of at most U members
differ in at most d = floor((1 - t) / (1 + t) * 2U) members. A hash deals the universe of shingles to m segments:

* d = 0: one segment, the whole set;
* small d: (d + 1) / 2 segments, each compared up to one deletion: a set is filed under its part of a segment and under that part
  less one member;
* else m = d + 1 + e segments compared whole, e about d / 3. At least e + 1 of them agree in a linked pair, so each set leaves out its
  e costliest, those that most sets share. The order (count, value) depends on content alone, so of the segments that
  agree, the longer prefix left out by either side has e members at most and one is left to both. A set that shares
  no more than e signatures with any others drops out.

A set is filed in its own band, and in each higher one in which it can have a linked partner. Signatures are counted first; only
those found twice are gathered with their sets. Signature groups are resolved by stars and verified exactly, not expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .components import components
from .textbytes import Hasher, Words, ascii_lower, bitmap, blank_separated, may_contain, mix, pieces, running, signed, text_buffer

SEED = 20
BAND_RATIO = 1.5
DELETIONS_UP_TO = 3  # differences for which one-deletion neighbourhoods are cheaper than whole segments
BLOCK = 512  # members of a signature group that one task compares with as many others
STARS = 1  # rounds in which each set is compared with a few hubs, before what is still open is compared pair by pair
HUBS = 3  # of a signature group in a round
MEETINGS = 6  # of a set with hubs in a round


def bands(largest: int, threshold: Fraction) -> np.ndarray:
    """Rows (lowest size, highest size, differences, segments, extra segments, one-deletion flag) for sizes 1..largest."""
    rows, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND_RATIO))
        differ = int((1 - threshold) / (1 + threshold) * 2 * high)
        if differ == 0:
            rows.append((low, high, 0, 1, 0, 0))
        elif differ <= DELETIONS_UP_TO:
            rows.append((low, high, differ, (differ + 2) // 2, 0, 1))
        else:
            extra = 1 + differ // 3
            rows.append((low, high, differ, differ + 1 + extra, extra, 0))
        low = high + 1
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


class ShingleSets:
    """Distinct shingles of the rows of a piece, sorted by row and hash."""

    def __init__(self, hasher: Hasher, data: np.ndarray, offsets: np.ndarray, width: int) -> None:
        words = Words(ascii_lower()[data], offsets, blank_separated())
        rows, count = len(offsets) - 1, np.diff(words.first)
        number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        row = np.repeat(np.arange(rows), number)
        within = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        start = words.first[row] + within
        shingle = hasher.ranges(hasher.words(words), start, start + np.minimum(count[row], width))
        order = np.lexsort((shingle, row))
        row, shingle = row[order], shingle[order]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
        self.row, self.shingle = row[fresh], shingle[fresh]
        self.size = np.bincount(self.row, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def class_id(self) -> np.ndarray:
        """One number for each distinct set; only rows with a shingle have a meaningful one."""
        total = running(mix(self.shingle + np.uint64(77)))
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit words, first word of each row): flags of whether an odd number of a row's members falls into a slot.

        A row of n members has the power of two from 4 n on as slots, 64 at least. A member that only one of two sets has turns one flag, so
        the sets differ in at least as many members as flags. The halves of a longer sketch, xor-ed, are the sketch of half as many slots.
        """
        words = np.maximum(1 << np.ceil(np.log2(np.maximum(self.size, 1) / 16)).clip(0).astype(np.int64), 1)
        first = np.concatenate([[0], np.cumsum(words)])
        slot = (mix(self.shingle + np.uint64(5)) % (words[self.row] * 64).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(first[self.row] * 64 + slot, minlength=int(first[-1]) * 64) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), first

    def signatures(self, threshold: Fraction) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
        """(own, row, band, signature) of every set, for its own band and for those of possible larger partners."""
        plan = bands(int(max(self.size.max(initial=0) / threshold, 1)), threshold)
        own = np.searchsorted(plan[:, 0], np.maximum(self.size, 1), side="right") - 1
        top = (self.size * threshold.denominator) // threshold.numerator  # largest size of a linked partner
        scrambled, where = mix(self.shingle), mix(self.shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        for up in range(len(plan)):
            band = own + up
            fits = (self.size > 0) & (band < len(plan))
            fits &= plan[np.minimum(band, len(plan) - 1), 0] <= top
            if not fits.any():
                return
            rows = np.flatnonzero(fits)
            place = np.full(len(self.size), -1)
            segments = plan[band[rows], 3]
            place[rows] = np.cumsum(segments) - segments
            member = np.flatnonzero(place[self.row] >= 0)
            row = self.row[member]
            parts = np.repeat(rows, segments)
            part = np.arange(len(parts)) - place[parts]
            cell = place[row] + (where[member] % plan[band[row], 3].astype(np.uint64)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            total = running(scrambled[member][order])
            ends = np.searchsorted(cell[order], np.arange(len(parts) + 1))
            sums = total[ends[1:]] - total[ends[:-1]]
            head = mix((band[parts] * 1_000_003 + part).astype(np.uint64))
            yield up == 0, parts, band[parts], mix(sums + head)
            dropped = plan[band[row], 5] == 1
            if dropped.any():
                cells = cell[dropped]
                yield up == 0, row[dropped], band[row[dropped]], mix(sums[cells] - scrambled[member[dropped]] + head[cells])


def _linked(shared: Column, left: Column, right: Column, threshold: Fraction) -> Column:
    return shared * threshold.denominator >= (left + right - shared) * threshold.numerator


def jaccard_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, threshold: Fraction = Fraction(85, 100)
) -> DataFrame:
    """id, _text_hash, n_shingles, class_id, links, component_id: one row per row of `docs`.

    class_id is the same for equal sets (null without words), links counts the distinct other sets found linked to it while
    components were formed, component_id is the smallest id that is reachable, the row's own included. Null and empty
    texts have no shingles, no class and no links; their component is their own id. Repeated rows have equal sets and so are
    linked. A null id takes part; where all ids of a component are null, so is component_id. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    key = F.xxhash64("id", "text")

    def of_batches(batches, emit):
        hasher = Hasher(SEED)
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield from emit(piece, ShingleSets(hasher, *text_buffer(piece.column("text")), width))

    def sizes(batches):
        def emit(piece, sets):
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("h"), pa.array(sets.size), pa.array(signed(sets.class_id()), mask=sets.size == 0)],
                ["id", "h", "n", "c"],
            )

        return of_batches(batches, emit)

    id_type = dict(source.dtypes)["id"]
    rows = materialize(source.select("id", key.alias("h"), "text").mapInArrow(sizes, f"id {id_type}, h long, n long, c long"), "sets")

    def all_signatures(batches):
        def emit(piece, sets):
            for _, _, _, signature in sets.signatures(threshold):
                yield pa.RecordBatch.from_arrays([pa.array(signed(signature))], ["s"])

        return of_batches(batches, emit)

    twice = source.select("text").mapInArrow(all_signatures, "s long").groupBy("s").agg(F.count("*").alias("k")).filter("k > 1")
    twice = materialize(twice, "signatures")
    flags = bitmap(twice, "s", 26)

    def shared_signatures(batches):
        def emit(piece, sets):
            classes = signed(sets.class_id())
            for own, row, band, signature in sets.signatures(threshold):
                hit = may_contain(flags, signature)
                row = row[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(signature[hit])), pa.array(classes[row]), pa.array(sets.size[row]), pa.array(band[hit]), pa.array([own] * len(row), pa.bool_())],
                    ["s", "c", "n", "band", "own"],
                )

        return of_batches(batches, emit)

    filed = source.select("text").mapInArrow(shared_signatures, "s long, c long, n long, band long, own boolean")
    filed = materialize(filed.distinct(), "filed")  # copies of a set meet here, before anything is joined
    # A pair counts in the band of its larger set, so a group without a set of its own band has no pair.
    group = filed.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("own").alias("any_own"), F.count("*").alias("k"))
    filed = filed.join(group.filter("low < high and any_own").select("s", "k"), "s")
    filed = materialize(_without_costly(filed, threshold).select("s", "c", "n", "own"), "filed")

    # Shingle arrays of one row of each class that shares a signature.
    wanted = filed.select("c").distinct()
    chosen = rows.filter("c is not null").groupBy("c").agg(F.min("h").alias("h")).join(wanted, "c")
    chosen = materialize(chosen, "chosen")
    chosen_flags = bitmap(chosen, "h", 24)

    def chosen_sets(batches):
        def wanted_rows():
            for batch in batches:
                hashes = batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64)
                yield batch.filter(pa.array(may_contain(chosen_flags, hashes.view(np.uint64))))

        def emit(piece, sets):
            lists = pa.ListArray.from_arrays(pa.array(sets.first, pa.int32()), pa.array(signed(sets.shingle)))
            flags, first = sets.parities()
            sketches = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flags))
            columns = [piece.column("h"), pa.array(signed(sets.class_id())), lists, sketches]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "members", "sketch"])

        return of_batches(wanted_rows(), emit)

    members = source.select(key.alias("h"), "text").mapInArrow(chosen_sets, "h long, c long, members array<long>, sketch array<long>")
    members = materialize(members.join(chosen, ["h", "c"]).dropDuplicates(["c"]).select("c", "members", "sketch"), "members")

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b, linked for the pairs (a, b): first by sketches, which never reject a linked pair, then by the sets."""

        def side(name, column):
            return members.select(F.col("c").alias(name), F.col(column).alias(f"m{name}"), F.size("members").cast("long").alias(f"n{name}"))

        def folded(x, to):
            """The sketch with as many slots as the shorter one; linked sets differ by a factor of two at most."""
            half = F.floor(F.size(x) / 2).cast("int")
            return F.when(F.size(x) > F.size(to), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

        turned = F.zip_with(folded("ma", "mb"), folded("mb", "ma"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        turned = F.aggregate(turned, F.lit(0), lambda n, x: n + x)
        most = (F.col("na") + F.col("nb")) * (threshold.denominator - threshold.numerator)
        sketched = pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")
        sketched = sketched.select("a", "b", (turned * (threshold.denominator + threshold.numerator) <= most).alias("close"))
        sketched = materialize(sketched, "sketched")
        both = sketched.filter("close").join(side("a", "members"), "a").join(side("b", "members"), "b")
        shared = F.size(F.array_intersect("ma", "mb")).cast("long")
        sure = both.select("a", "b", _linked(shared, F.col("na"), F.col("nb"), threshold).alias("linked"))
        return sure.union(sketched.filter("not close").select("a", "b", F.lit(False)))

    def possible(pairs: DataFrame) -> DataFrame:
        """Each pair once, a < b, if the sizes allow a link."""
        smaller, larger = F.least("na", "nb"), F.greatest("na", "nb")
        fits = pairs.filter("a <> b").filter(smaller * threshold.denominator >= larger * threshold.numerator)
        return fits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    tried = edges = None
    labels = spark.createDataFrame([], "node long, root long")
    for step in range(STARS + 2):
        state = filed.join(labels, filed.c == labels.node, "left").select("s", "c", "n", "own", F.coalesce("root", "c").alias("root"))
        hubs = [
            F.min(F.struct(F.xxhash64("c", F.lit(HUBS * step + i)).alias("rank"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb")))
            for i in range(HUBS)
        ]
        groups = state.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array_distinct(F.array(*hubs)).alias("hubs"))
        groups = groups.filter("low < high")
        if step < STARS:
            # Sets meet hubs of their open groups, those first with which they share most: pairs grow as the sets, however large the
            # groups are.
            near = state.join(groups.select("s", "hubs"), "s").select("c", "n", "root", F.explode("hubs").alias("hub"))
            near = near.filter("root <> hub.rb").groupBy(F.col("c").alias("a"), F.col("n").alias("na"), "hub.b", "hub.nb").agg(F.count("*").alias("k"))
            best = Window.partitionBy("a").orderBy(F.desc("k"), "b")
            pairs = possible(near.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= MEETINGS))
        else:
            # Mostly one component to a group now; what is still open is compared. First as few pairs as would join all that look
            # linked, which leaves little; then every pair that still looks linked.
            left = state.join(groups.select("s"), "s").join(members.select(F.col("c").alias("c2"), "sketch"), F.col("c") == F.col("c2"))
            left = materialize(left.select("s", "c", "n", "root", "own", "sketch"), "open")
            pairs = open_pairs(left, threshold.denominator + threshold.numerator, threshold.denominator - threshold.numerator, forest=step == STARS)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        result = materialize(verified(pairs), "verified")
        tried = result.select("a", "b") if tried is None else tried.union(result.select("a", "b"))
        found = result.filter("linked").select("a", "b")
        edges = found if edges is None else edges.union(found)
        if found.limit(1).count():
            labels = components(edges)

    degree = edges.select("a").union(edges.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("counted")).agg(F.count("*").alias("links"))
    classes = rows.filter("c is not null").groupBy("c").agg(F.min("id").alias("low"))
    classes = classes.join(labels, classes.c == labels.node, "left").join(degree, F.col("c") == F.col("counted"), "left")
    classes = classes.select("c", "low", F.coalesce("root", "c").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = materialize(classes, "classes")
    lowest = classes.groupBy("root").agg(F.min("low").alias("component"))
    classes = classes.join(lowest, "root").select(F.col("c").alias("k"), "links", "component")
    # Rows without words have no class: they would all meet in one task.
    joined = rows.filter("c is not null").join(classes, F.col("c") == F.col("k")).select("id", "h", "n", "c", "links", "component")
    without = rows.filter("c is null").select("id", "h", "n", "c", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return joined.union(without).select(
        F.col("id").alias(id_column),
        F.col("h").alias("_text_hash"),
        F.col("n").alias("n_shingles"),
        F.col("c").alias("class_id"),
        "links",
        F.col("component").alias("component_id"),
    )


def open_pairs(rows: DataFrame, up: int, down: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of a group `s` in different components `root` that differ in few enough flags: flags * up <= (n_a + n_b) * down.

    With `forest`, only pairs that join components which the pairs before them in the task have not joined: fewer than two blocks have members.

    `rows` has s, c, n, root, own and sketch; one of a pair must be `own`. A group is cut into blocks of about BLOCK members, and each two
    blocks meet in a task of their own: a group of any size is spread and a task holds two blocks. Only pairs that pass leave the task.
    """
    sizes = rows.groupBy("s").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    mine = F.pmod(F.xxhash64("c"), F.col("blocks"))
    rows = rows.join(sizes, "s").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("s", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "c", "n", "root", "own", "sketch")
    rows = rows.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")

    def compare(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
            kept = table.to_batches()[0] if table.num_rows else None
            if kept is None:
                continue
            ends = _group_ends(kept)
            yield _passing(kept.slice(0, ends[-2]), ends[:-1], up, down, forest)
            kept = kept.slice(ends[-2])
        if kept is not None and kept.num_rows:
            yield _passing(kept, np.array([0, kept.num_rows]), up, down, forest)

    return rows.mapInArrow(compare, "a long, b long")


def _group_ends(batch: pa.RecordBatch) -> np.ndarray:
    """0 and the end of each run of equal (s, i, j)."""
    keys = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in ("s", "i", "j")])
    return np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])


def _passing(batch: pa.RecordBatch, ends: np.ndarray, up: int, down: int, forest: bool) -> pa.RecordBatch:
    i, j, mine, c, n, root, own = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("i", "j", "mine", "c", "n", "root", "own"))
    flags = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    root = root.copy()  # joined as pairs are found, with `forest`
    words = batch.column("sketch").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(words) - words
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
        at = np.arange(low, high)
        one, two = (at[mine[at] == i[low]], at[mine[at] == j[low]]) if i[low] != j[low] else (at, at)
        width = int(words[at].min())  # of the shortest sketch in the group; longer ones are folded to it
        sketch = np.empty((high - low, width), dtype=np.uint64)
        for size in np.unique(words[at]).tolist():
            like = at[words[at] == size]
            long = flags[first[like][:, None] + np.arange(size)]
            while long.shape[1] > width:
                long = long[:, : long.shape[1] // 2] ^ long[:, long.shape[1] // 2 :]
            sketch[like - low] = long
        for x in one.tolist():
            y = two[(root[two] != root[x]) & (c[two] > c[x] if i[low] == j[low] else True) & (own[two] | own[x])]
            y = y[np.abs(n[y] - n[x]) * up <= (n[y] + n[x]) * down]
            turned = np.bitwise_count(sketch[y - low] ^ sketch[x - low]).sum(axis=1, dtype=np.int64)
            near = turned * up <= (n[y] + n[x]) * down
            y, turned = y[near], turned[near]
            if forest and len(y):
                y = y[np.lexsort((turned, root[y]))]  # the closest of each component
                y = y[np.concatenate([[True], root[y][1:] != root[y][:-1]])]
                inside = root[low:high]
                inside[np.isin(inside, root[y])] = root[x]
            if len(y):
                found.append((np.minimum(c[x], c[y]), np.maximum(c[x], c[y])))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _without_costly(filed: DataFrame, threshold: Fraction) -> DataFrame:
    """Leave out each set's commonest signatures, the extra segments of its band."""
    plan = bands(1 << 40, threshold)  # some 60 bands reach beyond any text
    table = filed.sparkSession.createDataFrame([(i, int(p[4])) for i, p in enumerate(plan)], "band long, extra long")
    order = Window.partitionBy("c", "band").orderBy(F.desc("k"), "s")
    return filed.withColumn("at", F.row_number().over(order)).join(F.broadcast(table), "band").filter("at > extra")
