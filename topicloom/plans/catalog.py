"""Registry of named queries over the shared tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..runtime import materialize, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(fn: Query) -> Query:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str, *columns: str | Column) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf: str, *extra: str, lang: str | None = None) -> DataFrame:
    """doc_id, extra..., tokens of all documents, or of one language."""
    docs = table(spark, sf, "documents")
    if lang:
        docs = docs.filter(F.col("lang") == lang)
    return spread(docs.select("doc_id", *extra, "text")).select("doc_id", *extra, TX.tokenize(F.col("text")).alias("tokens"))


def token_table(spark: SparkSession, sf: str, *extra: str, lang: str | None = None) -> DataFrame:
    """The same, written once: for queries that read the tokens several times."""
    return materialize(documents(spark, sf, *extra, lang=lang), "tokens")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem read as a run table."""
    flag = F.col("l_returnflag")
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_linestatus").alias("type"),
        F.sha2(F.col("l_suppkey").cast("string"), 256).alias("text_sha256"),
        flag.alias("alpha_str"),
        F.when(flag == "A", 0.01).when(flag == "N", 0.31).otherwise(0.61).alias("n_alpha"),
        F.col("l_tax").cast("string").alias("beta_str"),
        F.col("l_tax").alias("n_beta"),
        F.col("l_linenumber").alias("topics"),
        F.col("l_discount").alias("coherence"),
        (-F.col("l_quantity") / 10).alias("perplexity"),
        F.col("l_shipdate").alias("time"),
        "l_orderkey",
        "l_partkey",
        "l_extendedprice",
    )


RUN_ORDER = ["l_orderkey", "topics", "l_partkey", "l_extendedprice", "time", "perplexity", "coherence", "n_beta", "text_sha256"]

RUNS_CTE = """runs AS (
  SELECT l_linestatus AS type, sha256(CAST(l_suppkey AS VARCHAR)) AS text_sha256, l_returnflag AS alpha_str,
    CAST(CASE l_returnflag WHEN 'A' THEN 0.01 WHEN 'N' THEN 0.31 ELSE 0.61 END AS DOUBLE) AS n_alpha,
    CAST(l_tax AS VARCHAR) AS beta_str, l_tax AS n_beta, l_linenumber AS topics, l_discount AS coherence,
    -l_quantity / 10 AS perplexity, l_shipdate AS "time", l_orderkey, l_partkey, l_extendedprice
  FROM lineitem)"""

TOK_CTE = r"""tok AS (
  SELECT doc_id, lang, source, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'),
    lambda x: regexp_full_match(x, '[a-z]{2,}')) AS tokens
  FROM documents)"""

WORDS_CTE = TOK_CTE + ",\nwords AS (SELECT doc_id, lang, source, unnest(tokens) AS term FROM tok)"

BATCH_CTE = TOK_CTE + """,
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('75|' || CAST(doc_id AS VARCHAR)), doc_id) AS rank,
    CAST(floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) AS BIGINT) AS n_train FROM tok),
placed AS (
  SELECT *, CASE WHEN rank <= n_train THEN 'train' ELSE 'eval' END AS split,
    CASE WHEN rank <= n_train THEN rank - 1 ELSE rank - 1 - n_train END AS ofs FROM ranked),
batches AS (SELECT *, CAST(ofs // 50 AS BIGINT) AS batch_id, CAST(ofs % 50 AS BIGINT) AS pos FROM placed)"""
SEED = 75


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines agree to the last digit shown."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from . import model_queries, run_queries, source_queries, text_queries  # noqa: F401  (they register themselves)

    return QUERIES, SQL
