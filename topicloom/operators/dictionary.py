"""Dictionaries, bags of words, document-term matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import scalars as X
from ..runtime import balance, materialize, scratch_path
from .corpus_models import one_list
from .ranking import running_total
from .shape import unnest
from .skew import spread_join

BLOCK_TOKENS = 1 << 18  # tokens whose vectors are asked for together
OUT_TOKENS = 1 << 13  # tokens that leave a block together, with their vectors


def with_bag(docs: DataFrame, tokens: str = "tokens", name: str = "bag") -> DataFrame:
    """Add the array of (term, n) of each document.

    Tokens are sorted inside the row and run lengths taken, so counting words per document needs no
    shuffle.
    """
    return (
        docs.withColumn("_s", F.sort_array(tokens))
        .withColumn(
            "_at",
            F.filter(
                F.transform(
                    "_s", lambda v, i: F.when((i == 0) | (F.get("_s", i - 1) != v), i).otherwise(F.lit(-1))
                ),
                lambda i: i >= 0,
            ),
        )
        .withColumn(
            name,
            F.transform(
                "_at",
                lambda at, j: F.struct(
                    F.get("_s", at).alias("term"),
                    (F.coalesce(F.get("_at", j + 1), F.size("_s")) - at).cast("bigint").alias("n"),
                ),
            ),
        )
        .drop("_s", "_at")
    )


def term_rows(docs: DataFrame, keep: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """keep..., term, n: one row per document and distinct term, without a shuffle."""
    bags = with_bag(docs.select(*keep, tokens), tokens)
    return unnest(bags, keep, F.col("bag"), "b").select(*keep, "b.term", "b.n")


def term_counts(docs: DataFrame, batch: Sequence[str] = (), tokens: str = "tokens") -> DataFrame:
    """batch..., term, cf, df."""
    return term_rows(docs, batch, tokens).groupBy(*batch, "term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))


def build_dictionary(docs: DataFrame, batch: Sequence[str] = (), tokens: str = "tokens") -> DataFrame:
    """batch..., term, cf, df, term_id; ids count from 0 in term order, per batch or over the corpus."""
    counts = term_counts(docs, batch, tokens)
    if batch:  # the vocabulary of a batch is bounded by its documents
        order = Window.partitionBy(*batch).orderBy("term")
        return counts.withColumn("term_id", (F.row_number().over(order) - 1).cast("bigint"))
    ranked = running_total(counts, [F.col("term")], name="_r")
    return ranked.select("term", "cf", "df", (F.col("_r") - 1).alias("term_id"))


def add_documents(dictionary: DataFrame, docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Grow a dictionary: counts add up, known terms keep their ids, new terms follow in term order."""
    fresh = term_counts(docs, (), tokens).select("term", F.col("cf").alias("_cf"), F.col("df").alias("_df"))
    both = dictionary.join(fresh, "term", "full_outer").select(
        "term",
        (F.coalesce("cf", F.lit(0)) + F.coalesce("_cf", F.lit(0))).alias("cf"),
        (F.coalesce("df", F.lit(0)) + F.coalesce("_df", F.lit(0))).alias("df"),
        "term_id",
    )
    known = both.filter("term_id IS NOT NULL")
    top = dictionary.agg(F.coalesce(F.max("term_id"), F.lit(-1).cast("bigint"))).scalar()
    added = running_total(both.filter("term_id IS NULL").drop("term_id"), [F.col("term")], name="_r")
    return known.unionByName(added.select("term", "cf", "df", (top + F.col("_r")).alias("term_id")))


def doc2bow(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """key, term_id, n; terms outside the dictionary are dropped. Frequent terms are salted by document."""
    rows = term_rows(docs, [key], tokens)
    return spread_join(rows, dictionary.select("term", "term_id", "df"), ["term"], "df", [key]).select(key, "term_id", "n")


def bow_to_tokens(bow: DataFrame, key: str = "doc_id") -> DataFrame:
    """Term ids of each document in id order."""
    return bow.groupBy(key).agg(F.array_sort(F.collect_list("term_id")).alias("term_ids"))


def ids_to_terms(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    return rows.join(dictionary.select("term_id", "term"), "term_id")


def count_vectorize(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, features: the document-term matrix as sparse vectors over the dictionary's ids.

    The vectors are assembled as rows, written, and read back as ML vectors, so ids stay those of the
    dictionary and the same data always gives the same matrix. A vector holds its own terms only; ML vectors number columns by
    32 bits, so there are fewer than 2^31 terms.
    """
    n_terms = dictionary.count()
    bags = doc2bow(docs, dictionary, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term_id", "n"))).alias("b"))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(n_terms).cast("int").alias("size"),
        F.col("b.term_id").cast("array<int>").alias("indices"),
        F.col("b.n").cast("array<double>").alias("values"),
    )
    path = scratch_path(docs.sparkSession, "vectors")
    balance(bags.select(key, vector.alias("features")), key).sortWithinPartitions(key).write.parquet(path)
    schema = StructType([StructField(key, LongType()), StructField("features", VectorUDT())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def column_sums(vectors: DataFrame, features: str = "features") -> DataFrame:
    """term_id, total, nonzero: sum and number of entries of each column of sparse vectors, added up before the shuffle.

    No task and no driver holds a row as wide as the matrix; columns without entries have no row.
    """
    inner = F.unwrap_udt(features)
    entries = unnest(vectors, [], F.arrays_zip(inner["indices"].alias("at"), inner["values"].alias("value")), "e")
    counted = entries.filter(F.col("e.value") != 0).groupBy(F.col("e.at").cast("bigint").alias("term_id"))
    return counted.agg(F.sum("e.value").alias("total"), F.count("*").alias("nonzero"))


def batch_fingerprint(docs: DataFrame, batch: Sequence[str], order: str, tokens: str = "tokens") -> DataFrame:
    """Joined text of each batch (of bounded size) with its sha256 and md5."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("t"))))
    text = F.array_join(F.flatten(F.transform(ordered, lambda r: r["t"])), " ")
    joined = docs.groupBy(*batch).agg(F.count("*").alias("n_docs"), text.alias("text"))
    return joined.withColumn("text_sha256", X.text_sha256(F.col("text"))).withColumn("text_md5", X.text_md5(F.col("text")))


def word_frequencies(docs: DataFrame, stopwords: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """Word counts without stop words, which are dropped before the shuffle."""
    kept = term_rows(docs, (), tokens).filter(~F.col("term").isin(list(stopwords)))
    return kept.groupBy("term").agg(F.sum("n").alias("cf"))


def embed_tokens(docs: DataFrame, vectors: DataFrame, dim: int, key: str = "doc_id", tokens: str = "tokens", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """key, pos, token, found, vector for each token; a token without a vector gets zeros. Null tokens are left out.

    `vectors` has token and vector; a token with several of them gets a row for each. Documents meet the vectors by blocks: a block asks once
    for each of its distinct tokens, so neither tokens nor vectors are shuffled one by one, and no token is in more requests than there are blocks.
    Rows of a key leave together, whatever documents share it, as `stack_vectors` with `together` takes them.
    """
    kind = docs.schema[key].dataType.simpleString()
    near = docs.select(F.col(key).alias("key"), F.xxhash64(key).alias("mark"), F.col(tokens).alias("tokens"))
    near = near.repartition("mark").sortWithinPartitions("mark", "key")

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        lists = table.column("tokens").combine_chunks()
        words = lists.flatten().dictionary_encode()
        columns = [
            one_list(table.column("key").combine_chunks()),
            one_list(lists.value_lengths().fill_null(0)),
            one_list(words.indices.cast(pa.int32())),
            one_list(words.dictionary.cast(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["keys", "sizes", "ids", "terms"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, last = [], 0, None
        for batch in batches:
            marks = batch.column("mark").to_numpy()
            upto = np.cumsum(batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start, before = 0, 0
            for at in np.flatnonzero(marks != np.append(last if last is not None else ~marks[:1], marks[:-1])).tolist():  # first documents of a key
                here = total + (int(upto[at - 1]) if at else 0) - before
                if here >= block_tokens:
                    held.append(batch.slice(start, at - start))
                    yield block(held)
                    held, total, start, before = [], 0, at, int(upto[at - 1]) if at else 0
            held.append(batch.slice(start))
            total += int(upto[-1]) - before if len(upto) else 0
            last = marks[-1:] if len(marks) else last
        if held:
            yield block(held)

    packed = near.mapInArrow(cut, f"keys array<{kind}>, sizes array<int>, ids array<int>, terms array<string>")
    packed = materialize(packed.withColumn("block", F.monotonically_increasing_id()), "token-blocks")
    asked = packed.select(F.col("block").alias("at_block"), F.posexplode("terms").alias("local", "term"))
    known = vectors.select(F.col("token").alias("term"), "vector")
    sent = asked.join(known, "term").select("at_block", "local", "vector")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, sizes, ids, terms = (left.column(c).combine_chunks().flatten() for c in ("keys", "sizes", "ids", "terms"))
        sizes = sizes.to_numpy()
        order = np.argsort(right.column("local").to_numpy(), kind="stable")
        local = right.column("local").to_numpy()[order]
        found = right.column("vector").cast(pa.list_(pa.float64())).combine_chunks()
        found = pa.concat_arrays([found.take(pa.array(order)), pa.array([[0.0] * dim], found.type)])
        has = np.append(found.is_valid().to_numpy(zero_copy_only=False)[:-1], False)
        ends = np.searchsorted(local, np.arange(len(terms)), side="right")
        times = np.diff(ends, prepend=0)

        valid = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
        codes = ids.drop_null().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)[valid]
        pos = valid - np.append(0, np.cumsum(sizes))[owner]
        rows = []
        for low in range(0, len(codes), OUT_TOKENS):
            code = codes[low : low + OUT_TOKENS]
            n = np.maximum(times[code], 1)
            at = np.repeat(np.arange(len(code)), n)
            place = (ends - times)[code][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            place[times[code][at] == 0] = len(local)
            place[~has[place]] = len(local)
            at += low
            rows.append(
                pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(owner[at])), pa.array(pos[at].astype(np.int32)), terms.take(pa.array(codes[at])),
                        pa.array(has[place]), found.take(pa.array(place)),
                    ],
                    names,
                )
            )
        kinds = [keys.type, pa.int32(), terms.type, pa.bool_(), found.type]
        return pa.Table.from_batches(rows, pa.schema(list(zip(names, kinds))))

    names = [key, "pos", "token", "found", "vector"]
    schema = f"`{key}` {kind}, pos int, token string, found boolean, vector array<double>"
    return packed.groupBy("block").cogroup(sent.groupBy("at_block")).applyInArrow(run, schema)


def stack_vectors(rows: DataFrame, key: str = "doc_id", together: bool = False) -> DataFrame:
    """Vectors of each document in token order.

    With `together`, rows of a key stand side by side in one partition, as `embed_tokens` gives them; so no vector is shuffled.
    """
    if not together:
        pairs = rows.groupBy(key).agg(F.collect_list(F.struct("pos", "vector")).alias("pairs"))
    else:
        kind = rows.schema[key].dataType.simpleString()
        schema = f"`{key}` {kind}, pairs array<struct<pos:int,vector:array<double>>>"
        pairs = rows.select(key, "pos", "vector").mapInArrow(neighbours, schema)
    return pairs.select(key, F.transform(F.array_sort("pairs"), lambda r: r["vector"]).alias("vectors"))


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys, with the list of its other columns."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        codes = whole.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        pairs = pa.StructArray.from_arrays(whole.columns[1:], whole.schema.names[1:])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)), pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(first)), lists], [whole.schema.names[0], "pairs"])

    held = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(0)
        open_key = keys[batch.num_rows - 1]
        other = np.flatnonzero(np.diff(keys.dictionary_encode(null_encoding="encode").indices.to_numpy()))
        if len(other):  # what stands before the last key is whole
            last = int(other[-1]) + 1
            yield joined([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            if held and not held[-1].column(0)[held[-1].num_rows - 1].equals(open_key):
                yield joined(held)
                held = []
            held.append(batch)
    if held:
        yield joined(held)
