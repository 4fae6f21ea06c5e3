"""Queries that write the shared tables in the formats of the harvest and read them back."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as X
from ..functions import text as TX
from ..operators import corpus as C
from ..operators import runs as R
from ..operators import splits as S
from ..runtime import scratch_path, spread
from ..sources import readers as IN
from ..sources import writers as OUT
from ..streaming import streams
from .catalog import BATCH_CTE, RUNS_CTE, SEED, TOK_CTE, WORDS_CTE, documents, query, rounded, runs, table
from .text_queries import TOPWORDS_CTE, printed_topwords


@query("""SELECT o_orderpriority AS series, CAST(o_custkey AS INTEGER) AS file_size, o_orderstatus AS compress_type,
  CAST(o_custkey // 2 AS INTEGER) AS compress_size, CAST(o_custkey % 100 AS DOUBLE) AS compress_pct, o_orderdate AS date_time,
  substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS crc, 'a/' || o_orderkey || '.html' AS filename FROM orders""")
def read_mirror_listing(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "mirror")
    table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("Series"), F.col("o_custkey").alias("Length"), F.col("o_orderstatus").alias("Method"),
        F.floor(F.col("o_custkey") / 2).alias("Size"), F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("Cmpr"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("Date    Time"),
        F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8).alias("CRC-32"),
        F.concat(F.lit("a/"), F.col("o_orderkey").cast("string"), F.lit(".html")).alias("Name"),
    ).write.csv(path, header=True)
    return IN.read_mirror_listing(spark, path).withColumnRenamed("CRC", "crc")


META_SQL = """SELECT 'doc/' || doc_id AS url, CASE lang WHEN 'en' THEN 'mmwr_art' WHEN 'fr' THEN 'pcd_art' WHEN 'es' THEN 'eid_art' END AS stratum,
  lang, CAST(CASE WHEN doc_id % 7 = 0 THEN 9999 ELSE 2010 + doc_id % 12 END AS INTEGER) AS year FROM documents"""


def write_metadata(spark: SparkSession, sf: str) -> str:
    """Documents as the 23-column metadata file; German ones get a stratum outside the domain."""
    path = scratch_path(spark, "metadata")
    year = F.when(F.col("doc_id") % 7 != 0, F.concat((F.col("doc_id") % 12 + 2010).cast("string"), F.lit("-03")))
    known = {
        "url": F.concat(F.lit("doc/"), F.col("doc_id").cast("string")),
        "stratum": F.when(F.col("lang") == "en", "mmwr_art").when(F.col("lang") == "fr", "pcd_art").when(F.col("lang") == "es", "eid_art").otherwise("none"),
        "level": F.lit("article"),
        "lang": F.col("lang"),
        "dl_date": year,
        "title": F.concat(F.lit('a "quoted", title '), F.col("source")),
    }
    cols = [known.get(c, F.lit(None).cast("string")).alias(c) for c in schemas.CORPUS_COLUMNS]
    table(spark, sf, "documents").select(*cols).write.csv(path, header=True, escape='"')
    return path


@query(META_SQL)
def read_corpus_metadata(spark: SparkSession, sf: str) -> DataFrame:
    metadata = IN.read_corpus_metadata(spark, write_metadata(spark, sf))
    return metadata.select("url", "stratum", "lang", X.year_or_sentinel(F.col("dl_date")).alias("year"))


def _zip_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pages of a batch as one archive for each collection; a url that comes again goes to another archive."""
    for pdf in batches:
        packed = []
        for (name, _), part in pdf.groupby(["name", pdf.groupby(["name", "url"]).cumcount()]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"{name}.json", json.dumps(dict(zip(part["url"], part["html"])), ensure_ascii=False))
            packed.append((name, buffer.getvalue()))
        yield pd.DataFrame(packed, columns=["path", "content"])


@query("""SELECT url, 'html' AS fmt, CASE page_id % 2 WHEN 0 THEN 'mmwr_art_en' ELSE 'pcd_art_fr' END AS collection, html AS content FROM pages""")
def read_collections(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as zipped JSON collections, unpacked again."""
    name = F.when(F.col("page_id") % 2 == 0, "mmwr_art_en_html").otherwise("pcd_art_fr_html")
    archives = spread(table(spark, sf, "pages").select("url", "html", name.alias("name"))).mapInPandas(_zip_pages, "path string, content binary")
    return IN.unzip_collections(archives).select("url", "fmt", "collection", "content")


def write_token_arrays(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "tokens")
    docs = C.drop_empty(documents(spark, sf))
    docs.select(F.to_json(F.array(F.array(F.col("doc_id").cast("string")), F.col("tokens"))).alias("value")).write.text(path)
    return path


@query(f"""WITH {TOK_CTE} SELECT md5(array_to_string(tokens, ' ')) AS joined_md5, CAST(len(tokens) AS INTEGER) AS n_tokens FROM tok WHERE len(tokens) > 0""")
def read_tokenized(spark: SparkSession, sf: str) -> DataFrame:
    """JSON arrays of token lists: each holds the id as a one-word list, and the words."""
    rows = IN.read_tokenized(spark, write_token_arrays(spark, sf)).filter("pos = 1")
    return rows.select(F.md5(TX.join_tokens(F.col("tokens"))).alias("joined_md5"), F.size("tokens").alias("n_tokens"))


def _one_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a partition as the lines of one JSON array."""
    start = "["
    for pdf in batches:
        lines = pdf["value"]
        if len(lines):
            yield pd.DataFrame({"value": [start + lines.iloc[0], *("," + lines.iloc[1:])]})
            start = ","
    yield pd.DataFrame({"value": ["[]" if start == "[" else "]"]})


@query(f"""WITH {TOK_CTE} SELECT md5(array_to_string(tokens, ' ')) AS joined_md5, CAST(len(tokens) AS INTEGER) AS n_tokens FROM tok""")
def read_token_array(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in files of one array each, read by byte ranges."""
    path = scratch_path(spark, "arrays")
    docs = documents(spark, sf).select(F.coalesce(F.to_json("tokens"), F.lit("null")).alias("value"))
    docs.mapInPandas(_one_array, "value string").write.text(path)
    return IN.read_token_array(spark, path).select(F.md5(TX.join_tokens(F.col("tokens"))).alias("joined_md5"), F.size("tokens").alias("n_tokens"))


@query("SELECT count(*) AS n_documents FROM documents")
def count_records(spark: SparkSession, sf: str) -> DataFrame:
    return IN.count_records(table(spark, sf, "documents"))


@query(f"""WITH {TOK_CTE} SELECT CAST(2015 + doc_id % 5 AS INTEGER) AS year, count(*) AS n_documents, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens
FROM tok WHERE len(tokens) > 0 GROUP BY 1""")
def read_yearly_tokenized(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "yearly")
    docs = C.drop_empty(documents(spark, sf)).select((F.col("doc_id") % 5 + 2015).alias("year"), F.to_json("tokens").alias("value"))
    docs.repartition("year", F.pmod(F.hash("value"), F.lit(8))).write.partitionBy("year").text(path)
    rows = IN.read_yearly_tokenized(spark, path)
    return rows.groupBy("year").agg(F.count("*").alias("n_documents"), F.sum(F.size("tokens")).alias("n_tokens"))


@query(f"WITH {RUNS_CTE} SELECT type, topics, n_alpha, coherence, l_orderkey FROM runs")
def read_model_runs(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    runs(spark, sf).write.parquet(path)
    return IN.read_model_runs(spark, path).select("type", "topics", "n_alpha", "coherence", "l_orderkey")


DELIMITED = {"_index": "string", "type": "string", "topics": "int", "coherence": "double", "n_alpha": "double"}


@query(f"""WITH {RUNS_CTE} SELECT CAST(l_orderkey AS VARCHAR) AS _index, type, topics,
  CASE topics WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE coherence END AS coherence, CASE topics WHEN 1 THEN NULL ELSE n_alpha END AS n_alpha,
  topics = 2 AS error FROM runs""")
def read_runs_delimited(spark: SparkSession, sf: str) -> DataFrame:
    """A `;` file whose rows are short for one topic count and hold a bad number for another."""
    path = scratch_path(spark, "delimited")
    t = F.col("topics")
    fields = [F.col("l_orderkey").cast("string"), F.concat(F.lit('"'), F.col("type"), F.lit('"')), t.cast("string")]
    score = F.when(t == 2, "bad").otherwise(F.col("coherence").cast("string"))
    line = F.when(t == 1, F.concat_ws(";", *fields)).otherwise(F.concat_ws(";", *fields, score, F.col("n_alpha").cast("string")))
    lines = runs(spark, sf).select(line.alias(";".join(DELIMITED)))
    # one unquoted column whose name is the header line: short lines stay short
    lines.write.csv(path, header=True, sep="\u0001", quote="")
    return IN.read_runs_delimited(spark, path, DELIMITED)


def text_artifacts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as runs: the score is quality of the label, the artifact the text."""
    docs = table(spark, sf, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("time_key"), "doc_id", "text", "lang")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("coherence"))
    scored = docs.join(labels, "doc_id").select("time_key", "coherence")
    return scored, OUT.artifact_rows(docs, {"text": F.col("text"), "dictionary": F.col("lang")})


@query("""SELECT md5(CAST(d.doc_id AS VARCHAR)) AS time_key, text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality > 0.7""")
def load_texts_by_score(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "artifacts")
    scored, artifacts = text_artifacts(spark, sf)
    OUT.save_artifacts(artifacts, path)
    return IN.load_texts_by_score(scored, IN.read_artifacts(spark, path, "text"), 0.7)


@query("""SELECT md5(CAST(doc_id AS VARCHAR)) AS time_key, 'text' AS kind, text AS payload FROM documents
UNION ALL SELECT md5(CAST(doc_id AS VARCHAR)), 'dictionary', lang FROM documents""")
def save_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "artifacts")
    OUT.save_artifacts(text_artifacts(spark, sf)[1], path)
    return IN.read_artifacts(spark, path)


@query()
def file_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Size and age of the table files themselves."""
    stats = IN.file_stats(spark, f"{sf}/*.parquet")
    return stats.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "modificationTime")


@query(f"""WITH {WORDS_CTE} SELECT term AS word, count(*) AS n FROM words GROUP BY term""")
def read_word_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "words")
    documents(spark, sf).select(TX.join_tokens(F.col("tokens")).alias("value")).write.text(path)
    return IN.read_word_text(spark, path).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT page_id, url, html FROM pages")
def write_all_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json")
    pages = table(spark, sf, "pages")
    OUT.write_all_json(pages, path)
    return spark.read.schema(pages.schema).json(path)


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS url, o_orderpriority AS content FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998""")
def write_year_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "by-year")
    docs = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("url"), F.col("o_orderpriority").alias("content")
    )
    OUT.write_year_json(docs, path, (1996, 1998))
    return spark.read.schema("url bigint, content string, year int").json(path).select("year", "url", "content")


@query("""WITH d AS (SELECT 'doc/' || doc_id AS url, lang, CAST(CASE WHEN doc_id % 7 = 0 THEN 9999 ELSE 2010 + doc_id % 12 END AS INTEGER) AS year, md5(text) AS content_md5 FROM documents)
SELECT year, url, content_md5 FROM d WHERE lang = 'en' AND year BETWEEN 2015 AND 2019""")
def corpus_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata file and contents joined, filtered to English articles, written per year and read back."""
    path = scratch_path(spark, "by-year")
    metadata = C.date_key(IN.read_corpus_metadata(spark, write_metadata(spark, sf)))
    content = table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("index"), F.col("text").alias("content")
    )
    joined = C.content_metadata_join(content, metadata, "index", "url")
    articles = C.filter_articles(joined, range(2015, 2020))
    OUT.write_year_json(articles.select("url", "content", "year"), path)
    back = spark.read.schema("url string, content string, year int").json(path)
    return back.select("year", "url", F.md5("content").alias("content_md5"))


@query(f"""WITH {RUNS_CTE} SELECT type, CAST(topics AS INTEGER) AS topics, CAST(coherence AS FLOAT) AS coherence, count(*) AS n FROM runs GROUP BY type, topics, coherence""")
def append_model_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Train and eval runs appended one after the other, then counted."""
    path = scratch_path(spark, "runs")
    rows = R.enforce_run_schema(runs(spark, sf).select("type", "topics", "coherence"))
    for kind in ("F", "O"):
        OUT.append_model_runs(rows.filter(F.col("type") == kind), path)
    return spark.read.parquet(path).groupBy("type", "topics", "coherence").agg(F.count("*").alias("n"))


@query(f"""WITH {TOK_CTE} SELECT CAST(doc_id AS VARCHAR) AS time_key, lang AS type, CAST(len(tokens) AS INTEGER) AS topics,
  CASE len(tokens) WHEN 0 THEN '[[]]' ELSE '[["' || array_to_string(tokens, '","') || '"]]' END AS top_words FROM tok""")
def export_runs_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    rows = documents(spark, sf, "lang").select(
        F.col("doc_id").cast("string").alias("time_key"), F.col("lang").alias("type"), F.size("tokens").alias("topics"),
        F.array("tokens").alias("top_words"),
    )
    OUT.export_runs_csv(rows, path)
    kinds = {"time_key": "string", "type": "string", "topics": "int", "top_words": "string"}
    return IN.read_runs_delimited(spark, path, kinds).drop("error")


@query(f"""WITH {RUNS_CTE} SELECT text_sha256, alpha_str, n_alpha, topics, coherence, per_word, "time" FROM (SELECT *, perplexity AS per_word FROM runs)""")
def save_runs_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "table")
    name = "runs_" + path[-32:]
    OUT.save_runs_table(runs(spark, sf), name, path)
    saved = spark.table(name)
    return saved.select("text_sha256", "alpha_str", "n_alpha", "topics", "coherence", F.col("perplexity").alias("per_word"), "time")


TUNING_SQL = f"""WITH {RUNS_CTE} SELECT topics AS n_topics, alpha_str AS alpha, beta_str AS beta, round(median(coherence), 6) AS median_cv,
  round(sum(perplexity), 6) AS convergence_score, round(avg(perplexity), 6) AS log_perplexity FROM runs GROUP BY topics, alpha_str, beta_str"""


@query(TUNING_SQL)
def export_tuning_results(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ranking import median

    path = scratch_path(spark, "tuning")
    by = ["topics", "alpha_str", "beta_str"]
    rows = runs(spark, sf)
    sums = rows.groupBy(*by).agg(F.sum("perplexity").alias("convergence_score"), F.avg("perplexity").alias("log_perplexity"))
    results = rounded(
        median(rows, by, "coherence", "median_cv").join(sums, by).withColumnsRenamed({"topics": "n_topics", "alpha_str": "alpha", "beta_str": "beta"})
    )
    OUT.export_tuning_results(results, path + "/csv", path + "/log")
    kinds = "n_topics int, alpha string, beta string, median_cv double, convergence_score double, log_perplexity double"
    return spark.read.schema(kinds).csv(path + "/csv", header=True)


@query(rf"""WITH {TOPWORDS_CTE}, w AS (SELECT array_to_string(regexp_extract_all(top_words, '''([A-Za-z]+(?:_[A-Za-z]+)*)''', 1), ' ') AS line FROM printed)
SELECT line, count(*) AS n FROM w GROUP BY line""")
def write_topwords_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "topwords")
    OUT.write_topwords_text(printed_topwords(spark, sf), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(f"""WITH {WORDS_CTE} SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM words GROUP BY term""")
def stream_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive in eight files, three per micro-batch."""
    root = scratch_path(spark, "stream")
    docs = documents(spark, sf).select("doc_id", "tokens")
    docs.repartition(8, "doc_id").write.parquet(root + "/in")
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 3).parquet(root + "/in")
    streams.stream_dictionary(arriving, root + "/out", root + "/state").awaitTermination()
    return streams.current_dictionary(spark.read.parquet(root + "/out"))


@query("""SELECT md5(CAST(event_id AS VARCHAR)) AS time_key, event_type AS type, value AS coherence, user_id, CAST(epoch_us(ts) AS BIGINT) AS time_us FROM events""")
def stream_run_append(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive as run rows, each of them twice; every row is appended once with all its columns."""
    root = scratch_path(spark, "stream")
    key = F.md5(F.col("event_id").cast("string"))
    rows = table(spark, sf, "events").select(key.alias("time_key"), F.col("event_type").alias("type"), F.col("value").alias("coherence"), "user_id", F.col("ts").cast("timestamp").alias("time"))
    rows.union(rows).repartition(6).write.parquet(root + "/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(root + "/in")
    # The files are not in order of time, so the delay spans them all.
    streams.stream_run_append(arriving, root + "/out", root + "/state", delay="36500 days").awaitTermination()
    return streams.appended_runs(spark, root + "/out").withColumn("time_us", F.unix_micros("time")).drop("time")


@query(f"""WITH {BATCH_CTE} SELECT split, batch_id, CAST(count(*) AS BIGINT) AS n FROM batches GROUP BY split, batch_id""")
def batch_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return S.assign_batches(table(spark, sf, "documents", "doc_id"), "doc_id", SEED).groupBy("split", "batch_id").agg(F.count("*").alias("n"))
