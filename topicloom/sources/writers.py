"""Writers: corpus JSON, model-run table, artifacts, exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..runtime import materialize
from ..functions import text as TX


def write_all_json(docs: DataFrame, path: str) -> None:
    """The whole corpus as JSON lines."""
    docs.write.mode("overwrite").json(path)


def write_year_json(docs: DataFrame, path: str, years: tuple[int, int] = (2015, 2019)) -> None:
    """One folder per year in the inclusive range; the url stays beside the content."""
    docs.filter(F.col("year").between(*years)).write.mode("overwrite").partitionBy("year").json(path)


def append_model_runs(runs: DataFrame, path: str) -> None:
    """Adds files; rows already there are not rewritten."""
    runs.write.mode("append").parquet(path)


def export_runs_csv(runs: DataFrame, path: str) -> None:
    """`;` file with a header; arrays become JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in runs.dtypes]
    runs.select(*flat).write.mode("overwrite").csv(
        path, sep=";", header=True, quote='"', escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS"
    )


def artifact_rows(runs: DataFrame, payloads: dict[str, Column]) -> DataFrame:
    """One row per run and artifact kind, keyed by the run's time key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("payload")) for k, c in payloads.items()])
    return runs.select("time_key", F.inline(pairs))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("sha256 string, payload string, kind string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def store_payloads(rows: DataFrame, path: str) -> DataFrame:
    """Write each payload once under its hash and return the references: the other columns of `rows` (with kind) and sha256.

    `rows` has kind and payload. Content that `<path>/payloads` holds already is not written again, whichever run it came from; it is partitioned by
    kind. A null payload is left out.
    """
    hashed = materialize(rows.filter("payload is not null").withColumn("sha256", F.sha2("payload", 256)), "payloads")
    fresh = hashed.select("kind", "sha256", "payload").dropDuplicates(["kind", "sha256"])
    known = _stored(rows.sparkSession, f"{path}/payloads")
    if known is not None:
        fresh = fresh.join(known.select("kind", "sha256"), ["kind", "sha256"], "left_anti")
    fresh.write.mode("append").partitionBy("kind").parquet(f"{path}/payloads")
    return hashed.drop("payload")


def save_artifacts(artifacts: DataFrame, path: str) -> None:
    """Store the payloads of (time_key, kind, payload) by content, and what each run refers to in `<path>/index`."""
    save_references(store_payloads(artifacts, path), path)


def save_references(references: DataFrame, path: str) -> None:
    """Append (time_key, kind, sha256), partitioned by kind. Payloads are stored first: a run never refers to nothing."""
    references.select("time_key", "sha256", "kind").write.mode("append").partitionBy("kind").parquet(f"{path}/index")


# A hash of a text comes back in many runs: its column stays dictionary-coded where a file holds more hashes than a megabyte of them, and is
# judged after a page of many rows, not after the usual 20,000, in which few come twice.
DICTIONARY = {"parquet.dictionary.page.size": str(1 << 26), "parquet.page.row.count.limit": str(1 << 20)}


def save_runs_table(runs: DataFrame, table: str, path: str | None = None) -> None:
    """Create or replace the typed table; columns the rows lack are null."""
    have = set(runs.columns)
    typed = [
        (F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in schemas.RUNS_TABLE.items()
    ]
    writer = runs.select(*typed).write.mode("overwrite").options(**DICTIONARY)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


TUNING_COLUMNS = ["n_topics", "alpha", "beta", "median_cv", "convergence_score", "log_perplexity", "time_to_complete"]


def tuning_log_line(gamma: bool = False) -> Column:
    """One log line per grid point."""
    parts = [
        ("Number of Topics", "n_topics"),
        ("Alpha", "alpha"),
        ("Beta", "beta"),
        *([("Gamma", "gamma")] if gamma else []),
        ("Median Coherence Value (c_v)", "median_cv"),
        ("Convergence Score", "convergence_score"),
        ("Log Perplexity", "log_perplexity"),
    ]
    return F.concat_ws("  |  ", *[F.concat(F.lit(f"{t}: "), F.col(c).cast("string")) for t, c in parts])


def export_tuning_results(results: DataFrame, csv_path: str, log_path: str | None = None) -> None:
    """Metrics per grid point as CSV and, if asked, as log lines."""
    gamma = "gamma" in results.columns
    cols = [c for c in [*TUNING_COLUMNS, "gamma"] if c in results.columns]
    results.select(*cols).write.mode("overwrite").csv(csv_path, header=True)
    if log_path:
        results.select(tuning_log_line(gamma).alias("value")).write.mode("append").text(log_path)


def write_topwords_text(runs: DataFrame, path: str, column: str = "top_words", literal: bool = False) -> None:
    """One line of words per run."""
    runs.select(TX.words_in_single_quotes(F.col(column), literal).alias("value")).write.mode("overwrite").text(path)
