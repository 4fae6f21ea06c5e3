"""Two-word phrases: adjacent pairs, scores, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .dictionary import term_counts
from .shape import unnest
from .skew import spread_join


def adjacent_pairs(tokens: Column) -> Column:
    """Neighbouring tokens as 'a b' (text, because arrays of text de-duplicate by hash and structs do not)."""
    n = F.size(tokens)
    firsts = F.when(n > 1, F.slice(tokens, 1, n - 1)).otherwise(F.array().cast("array<string>"))
    seconds = F.when(n > 1, F.slice(tokens, 2, n - 1)).otherwise(F.array().cast("array<string>"))
    return F.zip_with(firsts, seconds, lambda a, b: F.concat(a, F.lit(" "), b))


def pair_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """a, b, n_ab over the corpus."""
    counts = unnest(docs, [], adjacent_pairs(F.col(tokens)), "pair").groupBy("pair").agg(F.count("*").alias("n_ab"))
    return counts.select(F.substring_index("pair", " ", 1).alias("a"), F.substring_index("pair", " ", -1).alias("b"), "n_ab")


def score_phrases(docs: DataFrame, min_count: int = 5, threshold: float = 10.0, tokens: str = "tokens") -> DataFrame:
    """a, b, n_ab, n_a, n_b, score = (n_ab - min) * V / (n_a * n_b), kept above the threshold."""
    counts = materialize(term_counts(docs, (), tokens).select("term", F.col("cf").alias("n")), "counts")
    size = counts.count()
    pairs = pair_counts(docs, tokens).filter(F.col("n_ab") >= min_count)
    left = counts.select(F.col("term").alias("a"), F.col("n").alias("n_a"))
    right = counts.select(F.col("term").alias("b"), F.col("n").alias("n_b"))
    both = spread_join(spread_join(pairs, left, ["a"], "n_a", ["b"]), right, ["b"], "n_b", ["a"])
    score = (F.col("n_ab") - min_count) * size / (F.col("n_a") * F.col("n_b"))
    return both.withColumn("score", score).filter(F.col("score") > threshold)


def chosen_places(hits: DataFrame, key: str) -> DataFrame:
    """key, at: the places of the phrases that are joined, in order. `hits` has key and pos, the place where a known pair begins.

    Pairs that overlap stand at neighbouring places. Taken from left to right without overlap, every other one of such a run is joined,
    beginning with its first: places less their rank are equal within a run, and the rank inside it decides.
    """
    within_doc = Window.partitionBy(key).orderBy("pos")
    runs = hits.withColumn("_run", F.col("pos") - F.row_number().over(within_doc))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy("pos"))
    odd = runs.withColumn("_place", place).filter(F.col("_place") % 2 == 1)
    return odd.groupBy(key).agg(F.array_sort(F.collect_list("pos")).alias("at"))


def merge_phrases(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Rewrite each document, joining phrases with `_`, left to right without overlap. Keys are distinct.

    Pairs meet the phrase table one by one; only the places of the joined ones travel back to the document, which is then put together
    from slices of its tokens. No Python runs.
    """
    pairs = unnest(docs, [key], adjacent_pairs(F.col(tokens)), "pair", "pos")
    table = phrases.select(F.concat_ws(" ", "a", "b").alias("pair"), "n_ab")
    hits = spread_join(pairs, table, ["pair"], "n_ab", [key, "pos"]).select(key, "pos")
    marked = docs.join(chosen_places(hits, key).withColumnRenamed("at", "_at"), key, "left")
    words, at, n = F.col(tokens), F.col("_at"), F.size("_at")
    following = F.concat(F.slice(at, 2, n), F.array(F.size(words)))

    def piece(c: Column) -> Column:
        """The joined pair at a place and the tokens up to the next place."""
        pair = F.concat(F.get(words, c["p"]), F.lit("_"), F.get(words, c["p"] + 1))
        return F.concat(F.array(pair), F.slice(words, c["p"] + 3, F.greatest(c["q"] - c["p"] - 2, F.lit(0))))

    joined = F.flatten(F.transform(F.arrays_zip(at.alias("p"), following.alias("q")), piece))
    merged = F.when(at.isNull(), words).otherwise(F.concat(F.slice(words, 1, F.get(at, F.lit(0))), joined))
    return marked.select(*[merged.alias(c) if c == tokens else F.col(c) for c in docs.columns])
