"""Structured Streaming: a growing dictionary, and run rows appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import term_rows


def stream_dictionary(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed terms of each micro-batch (term, cf, df, version) to `path`.

    Counts live in the state store, one row per term. Only changed terms are written, so the cost of a
    micro-batch follows its new documents and not the dictionary.
    """
    counts = term_rows(docs, [], "tokens").groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))

    def write(changed: DataFrame, version: int) -> None:
        # one folder per micro-batch: a repeated batch overwrites its own rows
        changed.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={version}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_dictionary(versions: DataFrame) -> DataFrame:
    """term, cf, df: the last version of each term."""
    last = F.max_by(F.struct("cf", "df"), "version").alias("_l")
    return versions.groupBy("term").agg(last).select("term", "_l.cf", "_l.df")


def stream_run_append(
    runs: DataFrame, path: str, checkpoint: str, key: str = "time_key", time: str = "time", delay: str = "1 day"
) -> StreamingQuery:
    """Append arriving run rows, all columns as they are; a key that comes again is dropped, also after a restart.

    The state holds the keys of the last `delay` of event time only: a run row is told again soon or not at all. Rows older than
    the watermark, the latest time seen less `delay`, are late and left out. Rows without a time have no place in that order and are left out,
    too. A micro-batch that is repeated after a failure overwrites its own folder.
    """

    def write(fresh: DataFrame, version: int) -> None:
        fresh.write.mode("overwrite").parquet(f"{path}/batch={version}")

    return (
        runs.filter(F.col(time).isNotNull())
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark([key])
        .writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def appended_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows appended so far."""
    return spark.read.parquet(path).drop("batch")
