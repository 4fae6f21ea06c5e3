"""The model-run table: schema, repair, identity, status, grouping reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as X
from ..runtime import materialize
from .shape import unnest
from .skew import spread_join


def enforce_run_schema(runs: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Cast every listed column present in `runs`; a value that does not fit becomes null."""
    types = types or schemas.MODEL_RUNS
    return runs.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in runs.columns])


def schema_violations(runs: DataFrame, key: str, types: dict[str, str] | None = None) -> DataFrame:
    """key, column_name, expected, actual, value for each value that does not fit its type."""
    types = types or schemas.MODEL_RUNS
    actual = dict(runs.dtypes)
    checks = [
        F.when(
            F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(),
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(t).alias("expected"),
                F.lit(actual[c]).alias("actual"),
                F.col(c).cast("string").alias("value"),
            ),
        )
        for c, t in types.items()
        if c in actual
    ]
    found = F.filter(F.array(*checks), lambda v: v.isNotNull())
    return unnest(runs, [key], found, "v").select(key, "v.*")


def unwrap_singletons(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arrays of length one become their element; any other length is an error."""

    def one(c: str) -> Column:
        message = F.lit(f"field {c} has multiple elements")
        kind = dict(runs.dtypes)[c][len("array<") : -1]
        return F.when(F.size(c) == 1, F.get(F.col(c), F.lit(0))).otherwise(F.raise_error(message).cast(kind))

    return runs.withColumns({c: one(c) for c in columns})


def rename_columns(runs: DataFrame) -> DataFrame:
    return runs.withColumnsRenamed({"coherence": "_coherence", "perplexity": "per_word_bound"})


def repair_scores(runs: DataFrame) -> DataFrame:
    """Non-finite coherence becomes 0; `_perplexity_` is 2^(-bound). Input as given by rename_columns."""
    return (
        runs.withColumn("coherence", X.repaired_score(F.col("_coherence").cast("string")))
        .withColumn("_perplexity_", X.perplexity_base2(F.col("per_word_bound")))
        .drop("_coherence")
    )


def stamp_run_columns(runs: DataFrame, batch_size: int, num_workers: int, num_documents: Column | int) -> DataFrame:
    documents = num_documents if isinstance(num_documents, Column) else F.lit(num_documents)
    return runs.withColumns(
        {"batch_size": F.lit(batch_size), "num_workers": F.lit(num_workers), "num_documents": documents.cast("int")}
    )


def run_identity(runs: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """time_key, hashes of the text, elapsed seconds."""
    return runs.withColumns(
        {
            "time_key": X.time_key(F.col(start)),
            "text_sha256": X.text_sha256(F.col(text)),
            "text_md5": X.text_md5(F.col(text)),
            "elapsed": X.elapsed_seconds(F.col(start), F.col(end)),
        }
    )


def attach_status(runs: DataFrame, status: DataFrame, key: str = "time_key") -> DataFrame:
    """Left join of the visualisation flags; runs without a status keep nulls."""
    return runs.join(status.select(key, "create_pylda", "create_pcoa"), key, "left")


def count_per_text(runs: DataFrame) -> DataFrame:
    """One row per text with its number of runs."""
    return runs.groupBy("text_sha256").agg(F.count("*").alias("sha_count")).filter("sha_count > 0")


MODEL_KEY = ["type", "topics", "n_alpha", "n_beta"]


def group_remerge(rows: DataFrame, by: Sequence[str], aggs: dict[str, Column], spread_by: Sequence[str]) -> DataFrame:
    """Group statistics repeated on every row of the group.

    An aggregate joined back instead of a window: the aggregate is combined before the shuffle and a hot
    group is salted over many tasks.
    """
    stats = rows.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()], F.count("*").alias("_rows"))
    return spread_join(rows, stats, by, "_rows", spread_by).drop("_rows")


def combination_counts(runs: DataFrame) -> DataFrame:
    """type, topics, n_alpha, n_beta, text_sha256, n: runs counted once, for all that follows."""
    return materialize(runs.groupBy(*MODEL_KEY, "text_sha256").agg(F.count("*").alias("n")), "combinations")


def count_per_model(combinations: DataFrame) -> DataFrame:
    """Distinct type, topics, text, priors with the count of runs per type, topics and priors.

    The text is not grouped, so the count covers all texts of the model. Input as given by
    combination_counts, so only distinct combinations are joined.
    """
    models = combinations.groupBy(*MODEL_KEY).agg(
        F.sum("n").alias("type_alpha_beta_count"), F.count("*").alias("_texts")
    )
    return spread_join(combinations.drop("n"), models, MODEL_KEY, "_texts", ["text_sha256"]).select(
        "type", "topics", "text_sha256", "n_alpha", "n_beta", "type_alpha_beta_count"
    )


def text_numbers(runs: DataFrame, seed: int = 0) -> tuple[Column, DataFrame]:
    """A number of 64 bits for text_sha256, and the table of both (_text, text_sha256).

    The number is a hash. Should two texts have the same, the next seed is taken, so equal numbers mean equal texts; null stays null.
    """
    while True:
        number = F.when(F.col("text_sha256").isNotNull(), F.xxhash64("text_sha256", F.lit(seed)))
        texts = materialize(runs.select(number.alias("_text"), "text_sha256").distinct(), "texts")
        if texts.groupBy("_text").count().filter("count > 1").isEmpty():
            return number, texts
        seed += 1


def explore_join(runs: DataFrame, run_key: Sequence[str]) -> DataFrame:
    """Runs joined to the model counts of their text and priors, with totals per type and text.

    Topics is not a join key: a run meets every topic count of its priors. The totals sha_count and
    model_sum cover all joined rows of a (type, text) and stand on each of them; they are computed from
    counts per key, without forming the joined rows first. Rows are shuffled with the number of their text; the text itself
    comes with the totals.
    """
    number, texts = text_numbers(runs)
    runs = runs.withColumn("text_sha256", number)
    combinations = combination_counts(runs)
    models = count_per_model(combinations)
    key = ["type", "text_sha256", "n_alpha", "n_beta"]
    runs_per_key = combinations.groupBy(*key).agg(F.sum("n").alias("_runs"))
    models_per_key = models.groupBy(*key).agg(
        F.collect_list(F.struct("topics", "type_alpha_beta_count")).alias("_models"),
        F.count("*").alias("_n"),
        F.sum("type_alpha_beta_count").alias("_sum"),
    )

    def nullsafe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & left[k].eqNullSafe(other[f"_k{i}"])
        return left.join(other, cond).drop(*[f"_k{i}" for i in range(len(keys))])

    per_key = materialize(nullsafe_join(runs_per_key, models_per_key, key), "per-key")
    totals = per_key.groupBy("type", "text_sha256").agg(
        F.sum(F.col("_runs") * F.col("_n")).alias("sha_count"), F.sum(F.col("_runs") * F.col("_sum")).alias("model_sum")
    )
    totals = nullsafe_join(totals, texts.select(F.col("_text").alias("text_sha256"), F.col("text_sha256").alias("_sha")), ["text_sha256"])
    lookup = nullsafe_join(per_key, totals, ["type", "text_sha256"]).select(
        *key, "_runs", "_models", "sha_count", "model_sum", "_sha"
    )
    kept = runs.select(*dict.fromkeys([*key, "alpha_str", "beta_str", *run_key]))
    joined = spread_join(kept, lookup, key, "_runs", run_key)
    return joined.select(
        "type",
        F.col("_sha").alias("left_sha"),
        F.col("_sha").alias("right_sha"),
        "alpha_str",
        "beta_str",
        "sha_count",
        "model_sum",
        F.inline("_models"),
    )


def best_model(runs: DataFrame, by: Sequence[str], score: str, key: Sequence[str]) -> DataFrame:
    """The run with the highest score per group; the largest key wins a tie."""
    fields = F.struct(*[F.col(c) for c in runs.columns if c not in by])
    return runs.groupBy(*by).agg(F.max_by(fields, F.struct(score, *key)).alias("_b")).select(*by, "_b.*")


def pair_models(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """The i-th row of two lists side by side; columns other than the ordinal get the suffixes _1 and _2."""
    a = left.select(ordinal, *[F.col(c).alias(f"{c}_1") for c in left.columns if c != ordinal])
    b = right.select(ordinal, *[F.col(c).alias(f"{c}_2") for c in right.columns if c != ordinal])
    return a.join(b, ordinal)


def concat_runs(*parts: DataFrame) -> DataFrame:
    """All rows; columns missing on one side are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_splits(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    return train.unionByName(evaluation).distinct()
