"""Topic models over a whole corpus, with no limit on terms, topics or documents, and many models in one scan.

Documents are packed once into blocks: word numbers and counts of about BLOCK_TOKENS tokens with the block's own list of terms. The topics
are a table (term, part, weights) whose parts are WIDTH columns wide; the columns of several models lie side by side. For a fit the terms are dealt
into buckets with routes to the blocks (`routes`). In a pass each block meets the weights of its own terms only, for GROUP_COLUMNS columns at a time,
infers its documents, and sends back expected counts for those terms, which are summed per bucket. So no task and no driver ever holds the vocabulary or
the columns of many models; what passes through the driver is one total per topic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, spread
from . import variational as V
from .routes import Routes, binaries, numbers, route

cloudpickle.register_pickle_by_value(V)

BLOCK_TOKENS = 1 << 20
CHUNK_ENTRIES, CHUNK_CELLS = 1 << 16, 1 << 20  # documents inferred together: entries at least, entries x topics
OUT_CELLS = 1 << 23  # numbers of the buckets that leave a block together
GROUP_COLUMNS = 64  # columns that a block meets together, or those of one model
WIDTH = 32

PACKED = "doc_ids array<long>, folds array<int>, first array<long>, ids array<int>, counts array<int>, terms array<string>"


@dataclass(frozen=True)
class Model:
    """One model to fit. With `fold`, documents of that fold are held out of training."""

    k: int
    alpha: float | tuple[float, ...]
    eta: float
    decay: float = 0.5
    offset: float = 1.0
    fold: int | None = None

    def prior(self) -> np.ndarray:
        return np.full(self.k, self.alpha) if np.isscalar(self.alpha) else np.asarray(self.alpha, dtype=float)


class Columns:
    """Where the topics of each model stand, and how they are cut into parts."""

    def __init__(self, models: Sequence[Model]) -> None:
        self.models = list(models)
        ends = np.cumsum([0] + [m.k for m in models]).tolist()
        self.of = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
        self.total = ends[-1]
        self.width = min(WIDTH, self.total)
        self.parts = -(-self.total // self.width)

    def groups(self) -> list[tuple[list[int], slice]]:
        """Models that meet a block together, by their places, and where their columns stand."""
        out = []
        for i, at in enumerate(self.of):
            if out and at.stop - out[-1][1].start <= GROUP_COLUMNS:
                out[-1] = ([*out[-1][0], i], slice(out[-1][1].start, at.stop))
            else:
                out.append(([i], at))
        return out

    def spread_over(self, values: Sequence[float], rest: float) -> list[list[float]]:
        """One value for each model as one for each column of each part."""
        flat = [v for m, v in zip(self.models, values) for _ in range(m.k)]
        flat += [rest] * (self.parts * self.width - self.total)
        return [flat[i : i + self.width] for i in range(0, len(flat), self.width)]


def gathered(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches (with a list column `tokens`) that hold about `block_tokens` tokens together, whole rows only."""
    held, total = [], 0
    for batch in batches:
        sizes = np.cumsum(batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            end = max(int(np.searchsorted(sizes, before + block_tokens - total, side="right")), start + 1)
            held.append(batch.slice(start, end - start))
            total += int(sizes[end - 1]) - before
            start = end
            if total >= block_tokens or start < batch.num_rows:
                yield held
                held, total = [], 0
    if held:
        yield held


def one_list(values: np.ndarray | pa.Array, kind: pa.DataType | None = None) -> pa.ListArray:
    """All values as the only row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def pack(docs: DataFrame, key: str = "doc_id", tokens: str = "tokens", folds: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """block, doc_ids, folds, first, ids, counts, terms: one row for each block of documents, written once.

    Blocks are cut while the documents are read, without a shuffle; one document is never split. Documents without
    tokens are kept with no entries. Null tokens are skipped, null keys allowed. A document's fold is a hash of its key.
    """
    source = spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(tokens).alias("tokens")))
    source = source.withColumn("fold", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(folds)), F.lit(0)).cast("int"))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("tokens").combine_chunks()
        words = lists.flatten().dictionary_encode()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(words.dictionary)
        codes = words.indices.fill_null(n).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)[codes < n]
        cells, counts = np.unique(row * max(n, 1) + codes[codes < n], return_counts=True)
        first = np.searchsorted(cells, np.arange(len(sizes) + 1) * max(n, 1))

        columns = [
            one_list(table.column("doc_id").combine_chunks(), pa.int64()),
            one_list(table.column("fold").combine_chunks(), pa.int32()),
            one_list(first, pa.int64()),
            one_list((cells % max(n, 1)).astype(np.int32), pa.int32()),
            one_list(counts.astype(np.int32), pa.int32()),
            one_list(words.dictionary.cast(pa.string()), pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_ids", "folds", "first", "ids", "counts", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(block, gathered(batches, block_tokens))

    return materialize(source.mapInArrow(run, PACKED).withColumn("block", F.monotonically_increasing_id()), "packed")


def packed_terms(packed: DataFrame) -> DataFrame:
    """Distinct terms of the packed documents."""
    return packed.select(F.explode("terms").alias("term")).distinct()


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)


def start_weights(terms: DataFrame, models: Sequence[Model], seed: int) -> DataFrame:
    """term, part, weights: normal(1, 0.1) draws keyed by term, topic and seed (gamma(100, 1/100) to first order)."""
    columns = Columns(models)

    def draw(t: int) -> Column:
        u, v = _uniform(F.col("term"), F.lit(t), F.lit(seed)), _uniform(F.lit(seed), F.lit(t), F.col("term"))
        return F.greatest(F.lit(1e-3), 1 + 0.1 * F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v))

    topics = [t for m in models for t in range(m.k)] + [None] * (columns.parts * columns.width - columns.total)
    kinds = sorted({t for t in topics if t is not None})
    drawn = terms.select("term", F.array(*[draw(t) for t in kinds]).alias("drawn"))
    parts = [
        F.array(*[F.lit(1.0) if t is None else F.get("drawn", F.lit(kinds.index(t))) for t in topics[i : i + columns.width]])
        for i in range(0, len(topics), columns.width)
    ]
    return drawn.select("term", F.posexplode(F.array(*parts)).alias("part", "weights"))


def column_totals(weights: DataFrame, columns: Columns) -> np.ndarray:
    """Sum over all terms of each topic column: one number for each topic of each model."""
    sums = weights.groupBy("part").agg(F.array(*[F.sum(F.get("weights", F.lit(i))) for i in range(columns.width)]).alias("sums"))
    out = np.ones(columns.parts * columns.width)
    for row in sums.collect():
        out[row.part * columns.width : (row.part + 1) * columns.width] = row.sums
    return out


def routed_totals(weights: DataFrame, columns: Columns) -> np.ndarray:
    """The same from the totals of buckets."""
    n = columns.parts * columns.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(n)
            for value in batch.column("totals"):
                out += numbers(value, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(out)], ["at", "value"])

    out = np.ones(n)
    for row in weights.select("totals").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row.value
    return out


class Block:
    """The documents of one block, with the weights of their terms in `width` columns."""

    def __init__(self, left: pa.Table, right: pa.Table, width: int) -> None:
        def values(name):
            return left.column(name).combine_chunks().flatten()

        self.doc_ids, self.folds = values("doc_ids"), values("folds").to_numpy()
        first, ids, counts = (values(c).to_numpy() for c in ("first", "ids", "counts"))
        self.block, self.buckets = left.column("block")[0].as_py(), right.column("bucket").to_numpy()
        self.local, self.slot = ([numbers(v, np.int32) for v in right.column(c)] for c in ("local", "slot"))
        n = int(max(ids.max(initial=-1), *(x.max() for x in self.local), -1)) + 1
        self.weights = np.ones((n, width))
        self.known = np.zeros(n, dtype=bool)  # words the model has not seen are left out
        for local, found in zip(self.local, right.column("weights")):
            self.weights[local] = numbers(found, np.float64, width)
            self.known[local] = True
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        kept = self.known[ids]
        self.row, self.ids, self.counts = row[kept], ids[kept], counts[kept].astype(float)
        self.n_tokens = np.bincount(self.row, self.counts, len(first) - 1).astype(np.int64)

    def chunks(self, chosen: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, entry numbers, first entry of each document) for the chosen documents that have words."""
        docs = np.flatnonzero(chosen & (self.n_tokens > 0))
        first = np.searchsorted(self.row, np.arange(len(chosen) + 1))
        ends = np.cumsum(first[docs + 1] - first[docs])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, max(CHUNK_ENTRIES, CHUNK_CELLS // k))))
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(docs)]):
            part = docs[low:high]
            sizes = first[part + 1] - first[part]
            indptr = np.concatenate([[0], np.cumsum(sizes)])
            yield part, np.arange(indptr[-1]) + np.repeat(first[part] - indptr[:-1], sizes), indptr


def _meet(
    packed: DataFrame, routes: Routes, weights: DataFrame, groups: list[tuple[list[int], slice]], work: Callable[[Block, int], pa.Table], schema: str
) -> DataFrame:
    """Run `work` on each block and group of models, with the weights that the block's terms have in the group's columns."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        group = key[1].as_py()
        at = groups[group][1]
        return work(Block(left, right, at.stop - at.start), group)

    each = F.explode(F.array(*[F.lit(i) for i in range(len(groups))])) if len(groups) > 1 else F.lit(0)
    documents = packed.select("block", "doc_ids", "folds", "first", "ids", "counts", each.alias("group"))
    sent = routes.sent(weights, [at for _, at in groups])
    return documents.groupBy("block", "group").cogroup(sent.groupBy("at_block", "at_group")).applyInArrow(run, schema)


def _routes(packed: DataFrame, weights: DataFrame, columns: Columns) -> Routes:
    return route(packed, weights, columns.parts, columns.width)


def expected_counts(packed: DataFrame, weights: DataFrame, models: Sequence[Model], iterations: int = 50, alike: bool = False) -> DataFrame:
    """term, part, stats: expected topic counts summed over the documents that each model trains on."""
    columns = Columns(models)
    routes = _routes(packed, weights, columns)
    return routes.rows(_expected_sums(packed, routes, routes.weights, columns, iterations, alike), "stats", columns.width)


def _expected_sums(packed: DataFrame, routes: Routes, weights: DataFrame, columns: Columns, iterations: int, alike: bool) -> DataFrame:
    """bucket, slot, stats: the same by the buckets of the routes.

    `alike` tells that models of as many topics have the same weights, as at the start of a fit: those with one prior share their inference.
    """
    log_total = V.digamma(routed_totals(weights, columns))
    together = columns.groups()

    def counted(block: Block, at: slice, totals: np.ndarray, prior: np.ndarray, chosen: np.ndarray, into: np.ndarray) -> None:
        beta = np.exp(V.digamma(block.weights[:, at]) - totals[at])
        for _, entries, indptr in block.chunks(chosen, len(prior)):
            word = block.ids[entries]
            _, expected = V.infer(indptr, block.counts[entries], beta[word], prior, iterations)
            for t in range(len(prior)):
                into[:, t] += np.bincount(word, expected[:, t], len(into))

    def work(block: Block, group: int) -> pa.Table:
        stats = np.zeros_like(block.weights)
        groups, (members, whole) = {}, together[group]
        totals = log_total[whole]
        for model, at in [(columns.models[i], slice(columns.of[i].start - whole.start, columns.of[i].stop - whole.start)) for i in members]:
            groups.setdefault((model.k, tuple(model.prior())) if alike else at.start, []).append((model, at))
        for members in groups.values():
            model, at = members[0]
            if len(members) == 1:
                counted(block, at, totals, model.prior(), np.ones(len(block.folds), dtype=bool) if model.fold is None else block.folds != model.fold, stats[:, at])
                continue
            folds = sorted({m.fold for m, _ in members if m.fold is not None})
            for fold in [*folds, None]:  # documents of each fold, then those of no fold that is held out
                of_fold = np.zeros((len(stats), model.k))
                counted(block, at, totals, model.prior(), block.folds == fold if fold is not None else ~np.isin(block.folds, folds), of_fold)
                for m, place in members:
                    if m.fold is None or m.fold != fold:
                        stats[:, place] += of_fold
        sizes = np.array([len(x) for x in block.local], dtype=np.int64)
        schema = pa.schema([("bucket", pa.int32()), ("at_block", pa.int64()), ("at_group", pa.int32()), ("slot", pa.binary()), ("stats", pa.binary())])
        cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), max(1, OUT_CELLS // stats.shape[1]))))
        out = []
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)]):  # buckets that leave together
            local, slot = (np.concatenate(x[low:high]) for x in (block.local, block.slot))
            names = [pa.array(block.buckets[low:high], pa.int32()), pa.array(np.full(high - low, block.block), pa.int64()), pa.array(np.full(high - low, group), pa.int32())]
            out.append(pa.RecordBatch.from_arrays([*names, binaries(slot, sizes[low:high]), binaries(stats[local], sizes[low:high])], schema=schema))
        return pa.Table.from_batches(out, schema)

    parts = _meet(packed, routes, weights, together, work, "bucket int, at_block long, at_group int, slot binary, stats binary")
    return routes.summed(parts, [at for _, at in together])


def advance(
    packed: DataFrame,
    weights: DataFrame,
    models: Sequence[Model],
    steps: Sequence[int],
    scale: float = 1.0,
    iterations: int = 50,
    alike: bool = False,
) -> DataFrame:
    """term, part, weights after the given steps of every model with these documents, over the same routes.

    `scale` is documents so far over documents here; `alike` holds for the first of the steps.
    """
    columns = Columns(models)
    routes = _routes(packed, weights, columns)
    held, etas = routes.weights, np.array(columns.spread_over([m.eta for m in models], 0.0)).ravel()
    for i, step in enumerate(steps):
        rates = np.array(columns.spread_over([(m.offset + step) ** -m.decay for m in models], 0.0)).ravel()

        def blend(w: np.ndarray, s: np.ndarray, r: np.ndarray = rates) -> np.ndarray:
            return w * (1 - r) + r * (etas + scale * s)

        held = routes.changed(held, _expected_sums(packed, routes, held, columns, iterations, alike and i == 0), blend)
    return materialize(routes.rows(held, "weights", columns.width), "weights")


def update(
    packed: DataFrame, weights: DataFrame, models: Sequence[Model], step: int = 0, scale: float = 1.0, iterations: int = 50, alike: bool = False
) -> DataFrame:
    """One step of every model with these documents; `scale` is documents so far over documents here."""
    return advance(packed, weights, models, [step], scale, iterations, alike)


def fit(packed: DataFrame, models: Sequence[Model], passes: int = 15, seed: int = 75, iterations: int = 50) -> DataFrame:
    """term, part, weights of all models after `passes` scans of the corpus, each of which serves every model."""
    weights = materialize(start_weights(packed_terms(packed), models, seed), "weights")
    return advance(packed, weights, models, range(passes), 1.0, iterations, alike=True)


def with_new_terms(weights: DataFrame | None, packed: DataFrame, models: Sequence[Model], seed: int = 75) -> DataFrame:
    """Weights for all terms of the documents: known ones as they are, new ones with seeded draws."""
    terms = packed_terms(packed)
    if weights is None:
        return materialize(start_weights(terms, models, seed), "weights")
    fresh = terms.join(weights.select("term").distinct(), "term", "left_anti")
    return materialize(weights.unionByName(start_weights(fresh, models, seed)), "weights")


def document_topics(packed: DataFrame, weights: DataFrame, models: Sequence[Model], index: int = 0, iterations: int = 50) -> DataFrame:
    """doc_id, n_tokens, bound, per_word_bound, distribution of each document, which may be held out.

    Words without weights do not count. A document without words has the prior as its distribution and no per-word bound.
    """
    columns = Columns(models)
    log_total = V.digamma(column_totals(weights, columns))
    model, at = columns.models[index], columns.of[index]

    def work(block: Block, _: int) -> pa.Table:
        prior = model.prior()
        log_beta = V.digamma(block.weights) - log_total[at]
        gamma = np.tile(prior, (len(block.folds), 1))
        bound = np.zeros(len(block.folds))
        for docs, entries, indptr in block.chunks(np.ones(len(block.folds), dtype=bool), model.k):
            rows = log_beta[block.ids[entries]]
            gamma[docs], _ = V.infer(indptr, block.counts[entries], np.exp(rows), prior, iterations)
            bound[docs] = V.document_bounds(indptr, block.counts[entries], rows, gamma[docs], prior)
        shares = gamma / gamma.sum(axis=1, keepdims=True)
        offsets = pa.array(np.arange(len(bound) + 1) * model.k, pa.int32())
        return pa.table(
            {"doc_id": block.doc_ids, "n_tokens": block.n_tokens, "bound": bound, "distribution": pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))}
        )

    routes = _routes(packed, weights, columns)
    rows = _meet(packed, routes, routes.weights, [([index], at)], work, "doc_id bigint, n_tokens bigint, bound double, distribution array<double>")
    return rows.withColumn("per_word_bound", F.when(F.col("n_tokens") > 0, F.col("bound") / F.col("n_tokens")))


def topic_bounds(weights: DataFrame, models: Sequence[Model]) -> list[float]:
    """For each model the term of the bound that belongs to its topics; one sum a topic passes through the driver."""
    columns = Columns(models)
    totals = column_totals(weights, columns)
    log_total = V.digamma(totals)
    eta = np.array(columns.spread_over([m.eta for m in models], 1.0)).ravel()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros(columns.parts * columns.width), 0
        for batch in batches:
            part = batch.column("part").to_numpy()
            w = batch.column("weights").flatten().to_numpy().reshape(-1, columns.width)
            at = part[:, None] * columns.width + np.arange(columns.width)
            inner = (eta[at] - w) * (V.digamma(w) - log_total[at]) + V.log_gamma(w) - V.log_gamma(eta[at])
            np.add.at(out, at, inner)
            n += int((part == 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out) + 1)), pa.array(np.append(out, n))], ["at", "value"])

    rows = weights.select("part", "weights").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    value = {r.at: r.value for r in rows}
    n_terms = value.get(len(totals), 0)
    out = []
    for model, at in zip(columns.models, columns.of):
        inner = sum(value.get(i, 0.0) for i in range(at.start, at.stop))
        edge = V.log_gamma(np.full(model.k, model.eta * max(n_terms, 1))) - V.log_gamma(totals[at])
        out.append(float(inner + edge.sum()))
    return out


def corpus_scores(packed: DataFrame, weights: DataFrame, models: Sequence[Model], iterations: int = 50) -> DataFrame:
    """model, held_out, n_docs, n_tokens, bound, per_word_bound, perplexity, perplexity_base2.

    For each model (by its place in `models`) one row for the documents it trains on and, if it has a fold, one for those held
    out, from one scan. The bound has the topics' term. Documents without known words count as documents only.
    """
    columns = Columns(models)
    log_total = V.digamma(column_totals(weights, columns))

    groups = columns.groups()

    def work(block: Block, group: int) -> pa.Table:
        rows, (members, whole) = [], groups[group]
        for m in members:
            model, at = columns.models[m], columns.of[m]
            log_beta = V.digamma(block.weights[:, at.start - whole.start : at.stop - whole.start]) - log_total[at]
            held = np.zeros(len(block.folds), dtype=bool) if model.fold is None else block.folds == model.fold
            for out in (False, True):
                chosen = held == out
                bound = 0.0
                for _, entries, indptr in block.chunks(chosen, model.k):
                    beta = log_beta[block.ids[entries]]
                    gamma, _ = V.infer(indptr, block.counts[entries], np.exp(beta), model.prior(), iterations)
                    bound += float(V.document_bounds(indptr, block.counts[entries], beta, gamma, model.prior()).sum())
                rows.append((m, out, int(chosen.sum()), int(block.n_tokens[chosen].sum()), bound))
        return pa.table(dict(zip(("model", "held_out", "n_docs", "n_tokens", "bound"), map(list, zip(*rows)))))

    routes = _routes(packed, weights, columns)
    rows = _meet(packed, routes, routes.weights, groups, work, "model long, held_out boolean, n_docs long, n_tokens long, bound double")
    sums = rows.groupBy("model", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "bound")]).filter("n_docs > 0")
    of_topics = F.get(F.array(*[F.lit(x) for x in topic_bounds(weights, models)]), F.col("model").cast("int"))
    scored = sums.withColumn("bound", F.col("bound") + of_topics).withColumn("per_word_bound", F.when(F.col("n_tokens") > 0, F.col("bound") / F.col("n_tokens")))
    return scored.withColumns({"perplexity": F.exp(-F.col("per_word_bound")), "perplexity_base2": F.pow(F.lit(2.0), -F.col("per_word_bound"))})


def topic_rows(weights: DataFrame, models: Sequence[Model], index: int = 0) -> DataFrame:
    """topic, term, weight of one model."""
    columns = Columns(models)
    at = columns.of[index]
    rows = weights.filter(F.col("part").between(at.start // columns.width, (at.stop - 1) // columns.width))
    rows = rows.select("term", "part", F.posexplode("weights").alias("place", "weight"))
    topic = F.col("part") * columns.width + F.col("place") - at.start
    return rows.select(topic.cast("int").alias("topic"), "term", "weight").filter(F.col("topic").between(0, at.stop - at.start - 1))


def grid_search(
    docs: DataFrame,
    topics: Sequence[int],
    alphas: Sequence[float],
    etas: Sequence[float],
    decays: Sequence[float] = (0.5, 0.7, 0.9),
    folds: int = 10,
    passes: int = 15,
    seed: int = 75,
    offset: float = 10.0,
) -> DataFrame:
    """k, alpha, eta, decay, fold, n_test, score, train_score: one row per grid point and fold.

    `docs` has doc_id and tokens. Grid points and folds are columns of one topic table, so a pass reads the corpus once for all of
    them; a model takes no counts from its own fold. Scores are bounds of the held-out and of the training documents.
    """
    points = [(k, a, e, d) for k in topics for a in alphas for e in etas for d in decays]
    models = [Model(k, a, e, d, offset, f) for k, a, e, d in points for f in range(folds)]
    packed = pack(docs, folds=folds)
    weights = fit(packed, models, passes, seed)
    scored = corpus_scores(packed, weights, models)
    described = docs.sparkSession.createDataFrame(
        [(i, m.k, float(m.alpha), m.eta, m.decay, m.fold) for i, m in enumerate(models)], "model long, k int, alpha double, eta double, decay double, fold int"
    )
    of = scored.groupBy("model").agg(
        F.sum(F.when(F.col("held_out"), F.col("n_docs"))).alias("n_test"),
        F.sum(F.when(F.col("held_out"), F.col("bound"))).alias("score"),
        F.sum(F.when(~F.col("held_out"), F.col("bound"))).alias("train_score"),
    )
    return described.join(of, "model").drop("model")
