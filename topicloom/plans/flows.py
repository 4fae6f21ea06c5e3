"""The three flows of the work: harvested files to a corpus, a corpus to model runs, runs to reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch_models as B
from ..operators import corpus as C
from ..operators import dictionary as D
from ..operators import geometry as G
from ..operators import grid as GR
from ..operators import runs as R
from ..operators import splits as S
from ..operators import stats as ST
from ..runtime import materialize
from ..sources import readers as IN
from ..sources import writers as OUT


GRID_AXES = ["topics", "alpha_str", "beta_str", "gamma", "type"]


def prepare_corpus(
    spark: SparkSession, collections: str, metadata: str, out: str, years: Sequence[int] = range(2015, 2020), fmt: str = "html",
    excluded: DataFrame | None = None,
) -> DataFrame:
    """Zipped collections and the metadata file -> English articles per year, written and returned.

    One plan: contents of one format, last collection wins, joined to the metadata, filtered, partitioned by
    year. `excluded` is an optional list of urls.
    """
    contents = C.merge_collections(IN.read_collections(spark, collections).filter(F.col("fmt") == fmt))
    keyed = C.date_key(IN.read_corpus_metadata(spark, metadata))
    # the filters touch only metadata, so they go below the join
    articles = C.filter_articles(keyed, list(years))
    joined = C.content_metadata_join(contents.withColumnRenamed("url", "index"), articles, "index", "url")
    if excluded is not None:
        joined = C.exclude_keys(joined, excluded, "url", excluded.columns[0])
    OUT.write_year_json(joined.select("url", "content", "year"), out, (min(years), max(years)))
    return spark.read.schema("url string, content string, year int").json(out)


def train_grid(
    docs: DataFrame, out: str, seed: int = 75, grid: DataFrame | None = None, batch_size: int = S.BATCH_SIZE, workers: int = 0, **settings
) -> DataFrame:
    """Tokenised documents (doc_id, tokens) -> model runs, appended to `<out>/runs`, artifacts in `<out>/artifacts`.

    Split, batch, draw from the grid, fit every drawn point on every batch, place the documents of each model on
    the two-axis map, and keep text, tokens and model of each run.
    """
    spark = docs.sparkSession
    grid = GR.hyperparameter_grid(spark) if grid is None else grid
    drawn = GR.sample_grid(grid, [c for c in GRID_AXES if c in grid.columns], seed)
    batches = materialize(S.assign_batches(C.drop_empty(docs), "doc_id", seed, size=batch_size), "batches")
    fits = materialize(B.fit_per_batch(batches, drawn, keep_weights=True, **settings), "fits")
    fingerprints = materialize(D.batch_fingerprint(batches, ["split", "batch_id"], "pos"), "fingerprints")
    runs = B.train_run_rows(fits, fingerprints, batch_size, workers, 0, passes=settings.get("passes", B.PASSES))
    n_runs = fits.count()

    keyed = fits.withColumn("time_key", B.run_time_key())
    keys = keyed.select("time_key", *B.run_key_columns())
    placed = materialize(G.pcoa_2d(B.doc_topic_rows(fits).join(keys, B.run_key_columns()).drop(*B.run_key_columns()), ["time_key"], "doc_id"), "placed")
    OUT.append_model_runs(placed, f"{out}/topic_map")
    words = materialize(B.topic_tables(keyed), "topic_tables")
    OUT.append_model_runs(words, f"{out}/topic_tables")
    # A flag is set where the table has rows of the run.
    mapped, tabled = (t.select("time_key").distinct().withColumn(flag, F.lit(True)) for t, flag in ((placed, "create_pcoa"), (words, "create_pylda")))
    status = tabled.join(mapped, "time_key", "full_outer")
    stamped = R.stamp_run_columns(runs.drop("create_pylda", "create_pcoa"), batch_size, workers, n_runs)
    order = runs.columns
    OUT.append_model_runs(R.attach_status(stamped, status).select(*order), f"{out}/runs")

    # Texts and dictionaries are stored once for all runs of a batch, models once each.
    shared = OUT.store_payloads(B.batch_payloads(batches), f"{out}/artifacts")
    OUT.save_references(keyed.select("time_key", "split", "batch_id").join(shared, ["split", "batch_id"]), f"{out}/artifacts")
    OUT.save_artifacts(OUT.artifact_rows(keyed, {"lda_model": B.model_payload()}), f"{out}/artifacts")
    return IN.read_model_runs(spark, f"{out}/runs")


def analyse_runs(runs: DataFrame, threshold: float = 0.8, topics: int = 110) -> dict[str, DataFrame]:
    """The reports over a run table, by name. `runs` has MODEL_RUNS columns; scores may be text."""
    fixed = R.repair_scores(R.rename_columns(runs))
    variables = ["coherence", "per_word_bound", "_perplexity_"]
    reports: dict[str, DataFrame] = {}
    for split in ("train", "eval"):
        part = fixed.filter(F.col("type") == split)
        reports[f"{split}_moments"] = ST.moments(part, ["text_sha256"], variables)
        reports[f"{split}_quantiles"] = ST.quantiles(part, ["text_sha256"], variables)
        reports[f"{split}_extremes"] = ST.extremes(part, ["text_sha256"], variables, "time_key")
        reports[f"{split}_location"] = ST.location_tests(part, ["text_sha256"], variables)
        reports[f"{split}_missing"] = ST.missing_values(part, ["text_sha256"], variables)
        reports[f"{split}_labels"] = ST.crosstab(part, ["text_sha256"], "alpha_str", "beta_str")
        reports[f"{split}_numbers"] = ST.crosstab(part, ["text_sha256"], "n_alpha", "n_beta")
    reports["by_topics"] = ST.crosstab(fixed, ["type", "text_sha256"], "alpha_str", "beta_str", ["topics"])
    reports["high_scores"] = fixed.filter(F.col("coherence") > threshold).select("type", "topics", "coherence")
    reports["one_topic_count"] = fixed.filter(F.col("topics") == topics).select("type", "time_key", "coherence")
    reports["explore"] = R.explore_join(runs, ["time_key"])
    return reports
