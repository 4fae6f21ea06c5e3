"""Ways of topic weights between the table of terms and the blocks of documents.

Terms are dealt into buckets by hash, each with the weights of its terms as one matrix. A bucket knows once and for all which of its terms each block
has and where they stand there, so a pass shuffles one row for each bucket and block instead of one for each of a block's terms, and
joins no strings. Buckets are so many that a bucket's matrix and all that it sends to blocks are about BUCKET_CELLS numbers. Each goes to Python by
itself: Arrow batches are cut by rows, and one of all buckets in a partition would hold as much memory as these have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

BUCKET_CELLS = 1 << 20

ROUTED = "bucket int, terms array<string>, weights binary, totals binary, blocks array<long>, sizes array<int>, local binary, slot binary"


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of `sizes` rows of `values` as the binary values of a column."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * width
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def numbers(value: pa.BinaryScalar, kind: type, width: int | None = None) -> np.ndarray:
    """A binary value as numbers, or as a matrix of `width` columns."""
    flat = np.frombuffer(value.as_buffer(), dtype=kind)
    return flat if width is None else flat.reshape(-1, width)


def _each_bucket(met: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    """`run` on the row of each bucket alone; `met` is partitioned and sorted by bucket already."""

    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(table.to_batches())), pa.schema(list(kinds.items())))

    return met.groupBy("bucket").applyInArrow(one, schema)


@dataclass(frozen=True)
class Routes:
    """terms (bucket, terms), weights (bucket, weights, totals) as they were given, and ways (bucket, blocks, sizes, local, slot)."""

    terms: DataFrame
    weights: DataFrame
    ways: DataFrame
    columns: int

    def sent(self, weights: DataFrame, groups: Sequence[slice] | None = None) -> DataFrame:
        """at_block, at_group, bucket, local, slot, weights: for each block and bucket the weights of the terms that the block has.

        Each group of columns travels by itself, all columns as one without `groups`.
        """
        columns = self.columns
        groups = list(groups or [slice(0, columns)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                    sizes = batch.column("sizes")[i].values.to_numpy()
                    if len(sizes) == 0:
                        continue
                    local, slot = (numbers(batch.column(c)[i], np.int32) for c in ("local", "slot"))
                    table = numbers(batch.column("weights")[i], np.float64, columns)
                    ways = [binaries(x, sizes) for x in (local, slot)]
                    for group, at in enumerate(groups):
                        names = [pa.array(np.full(len(sizes), x, np.int32)) for x in (group, bucket)]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("blocks")[i].values, *names, *ways, binaries(table[:, at][slot], sizes)],
                            ["at_block", "at_group", "bucket", "local", "slot", "weights"],
                        )

        met = weights.join(self.ways.hint("merge"), "bucket").select("bucket", "weights", "blocks", "sizes", "local", "slot")
        kinds = {"at_block": pa.int64(), "at_group": pa.int32(), "bucket": pa.int32()} | dict.fromkeys(("local", "slot", "weights"), pa.binary())
        return _each_bucket(met, run, "at_block long, at_group int, bucket int, local binary, slot binary, weights binary", kinds)

    def summed(self, parts: DataFrame, groups: Sequence[slice]) -> DataFrame:
        """bucket, slot, stats: the parts (bucket, at_block, at_group, slot, stats) of all blocks and groups of columns added up, block by block."""
        columns, groups = self.columns, list(groups)

        def run(table: pa.Table) -> pa.Table:
            slots = [numbers(v, np.int32) for v in table.column("slot")]
            places = [groups[g] for g in table.column("at_group").to_pylist()]
            stats = [numbers(v, np.float64, at.stop - at.start) for v, at in zip(table.column("stats"), places)]
            n = max(int(s.max()) for s in slots) + 1
            sums, seen = np.zeros((n, columns)), np.zeros(n, dtype=bool)
            for i in np.argsort(table.column("at_block").to_numpy(), kind="stable").tolist():
                sums[slots[i], places[i]] += stats[i]
                seen[slots[i]] = True
            slot = np.flatnonzero(seen).astype(np.int32)
            size = np.array([len(slot)])
            return pa.table({"bucket": table.column("bucket").combine_chunks()[:1], "slot": binaries(slot, size), "stats": binaries(sums[slot], size)})

        return parts.groupBy("bucket").applyInArrow(run, "bucket int, slot binary, stats binary")

    def changed(self, weights: DataFrame, sums: DataFrame, blend: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """bucket, weights, totals: `blend` of each bucket's weights and sums, written; terms in no block have sums of 0."""
        columns = self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    held = numbers(batch.column("weights")[i], np.float64, columns)
                    stats = np.zeros_like(held)
                    if batch.column("slot")[i].is_valid:
                        stats[numbers(batch.column("slot")[i], np.int32)] = numbers(batch.column("stats")[i], np.float64, columns)
                    fresh = blend(held, stats)
                    columns_of = [binaries(fresh, np.array([len(held)])), binaries(fresh.sum(axis=0), np.array([columns]))]
                    yield pa.RecordBatch.from_arrays([batch.column("bucket").slice(i, 1), *columns_of], ["bucket", "weights", "totals"])

        met = weights.join(sums.hint("merge"), "bucket", "left").select("bucket", "weights", "slot", "stats")
        kinds = {"bucket": pa.int32(), "weights": pa.binary(), "totals": pa.binary()}
        return materialize(_each_bucket(met, run, "bucket int, weights binary, totals binary", kinds), "weights")

    def rows(self, held: DataFrame, name: str, width: int) -> DataFrame:
        """term, part and the numbers of a term in parts of `width` columns; `held` has bucket, `name` and, if not for all terms, slot."""
        columns, some = self.columns, "slot" in held.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    terms = batch.column("terms")[i].values
                    if some:
                        terms = terms.take(pa.array(numbers(batch.column("slot")[i], np.int32)))
                    values = numbers(batch.column(name)[i], np.float64, columns)
                    parts, n = columns // width, len(terms)
                    yield pa.RecordBatch.from_arrays(
                        [
                            terms.take(pa.array(np.repeat(np.arange(n), parts))),
                            pa.array(np.tile(np.arange(parts, dtype=np.int32), n)),
                            pa.ListArray.from_arrays(pa.array(np.arange(n * parts + 1) * width, pa.int32()), pa.array(values.ravel())),
                        ],
                        ["term", "part", name],
                    )

        met = held.join(self.terms.hint("merge"), "bucket").select("bucket", "terms", name, *["slot"] * some)
        kinds = {"term": pa.string(), "part": pa.int32(), name: pa.list_(pa.float64())}
        return _each_bucket(met, run, f"term string, part int, {name} array<double>", kinds)


def route(packed: DataFrame, weights: DataFrame, parts: int, width: int) -> Routes:
    """Routes between the topic table (term, part, weights) and packed blocks (block, terms), written once; terms without weights have none."""
    spark, columns = packed.sparkSession, parts * width
    n_pairs = packed.agg(F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()[0]
    n_buckets = max(spark.sparkContext.defaultParallelism, -(-max(n_pairs, weights.count() // parts) * columns // BUCKET_CELLS))
    bucket = F.pmod(F.xxhash64("term"), F.lit(n_buckets)).cast("int")
    pairs = packed.select("block", F.posexplode("terms").alias("local", "term")).withColumn("at_bucket", bucket)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        coded = left.column("term").combine_chunks().dictionary_encode()
        terms = coded.dictionary
        table = np.ones((len(terms), parts, width))
        flat = left.column("weights").combine_chunks().flatten().to_numpy().reshape(-1, width)
        table[coded.indices.to_numpy(), left.column("part").to_numpy()] = flat
        slot = pc.index_in(right.column("term").combine_chunks(), value_set=terms)
        known = slot.is_valid().to_numpy(zero_copy_only=False)
        slot = slot.fill_null(0).to_numpy()[known]
        block, local = (right.column(c).to_numpy()[known] for c in ("block", "local"))
        order = np.lexsort((local, block))
        blocks, sizes = np.unique(block, return_counts=True)
        size = np.array([len(slot)])
        row = {
            "bucket": left.column("bucket").combine_chunks()[:1],
            "terms": pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
            "weights": binaries(table.reshape(-1, columns), np.array([len(terms)])),
            "totals": binaries(table.reshape(-1, columns).sum(axis=0), np.array([columns])),
            "blocks": pa.ListArray.from_arrays(pa.array([0, len(blocks)], pa.int32()), pa.array(blocks, pa.int64())),
            "sizes": pa.ListArray.from_arrays(pa.array([0, len(blocks)], pa.int32()), pa.array(sizes, pa.int32())),
            "local": binaries(local[order].astype(np.int32), size),
            "slot": binaries(slot[order].astype(np.int32), size),
        }
        return pa.table({k: v[: min(len(terms), 1)] for k, v in row.items()})

    dealt = weights.withColumn("bucket", bucket).groupBy("bucket").cogroup(pairs.groupBy("at_bucket")).applyInArrow(run, ROUTED)
    routed = materialize(dealt, "routes")
    return Routes(routed.select("bucket", "terms"), routed.select("bucket", "weights", "totals"), routed.select("bucket", "blocks", "sizes", "local", "slot"), columns)
