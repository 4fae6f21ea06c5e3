"""Queries over the run table (lineitem read as runs): repair, statistics, tables, explore join, grid reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import priors as P
from ..functions import scalars as X
from ..operators import corpus as C
from ..operators import grid as GR
from ..operators import runs as R
from ..operators import stats as ST
from ..operators.ranking import row_index
from .catalog import RUN_ORDER, RUNS_CTE, SEED, query, rounded, runs, table

TRAIN, EVAL = "F", "O"
VARS = ["coherence", "per_word_bound", "_perplexity_"]
FIXED_CTE = RUNS_CTE + """,
fixed AS (SELECT * EXCLUDE (perplexity), perplexity AS per_word_bound, pow(2, -perplexity) AS _perplexity_ FROM runs)"""
LONG_CTE = FIXED_CTE + """,
v AS (SELECT type, text_sha256, variable, value FROM (
  SELECT type, text_sha256, 'coherence' AS variable, coherence AS value FROM fixed
  UNION ALL SELECT type, text_sha256, 'per_word_bound', per_word_bound FROM fixed
  UNION ALL SELECT type, text_sha256, '_perplexity_', _perplexity_ FROM fixed))"""


def fixed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return R.repair_scores(R.rename_columns(runs(spark, sf)))


# --- projections and filters -----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(o_custkey % 100 AS DOUBLE) AS pct FROM orders""")
def percent_to_number(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%"))
    return table(spark, sf, "orders").select("o_orderkey", X.percent_to_number(text).alias("pct"))


@query("""SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 9999 ELSE year(o_orderdate) END AS INTEGER) AS year FROM orders""")
def year_or_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    """Full dates, months without a day, and missing dates by order status."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    month = F.date_format("o_orderdate", "yyyy-MM")
    text = F.when(F.col("o_orderstatus") == "F", day).when(F.col("o_orderstatus") == "O", month)
    return table(spark, sf, "orders").select("o_orderkey", X.year_or_sentinel(text).alias("year"))


SEGMENTS = ["MACHINERY", "BUILDING", "HOUSEHOLD", "FURNITURE"]


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD', 'FURNITURE') THEN c_mktsegment END AS segment,
  CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 WHEN 'FURNITURE' THEN 3 END AS INTEGER) AS place
FROM customer""")
def ordered_category(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey", X.in_domain(segment, SEGMENTS).alias("segment"), X.category_ordinal(segment, SEGMENTS).alias("place")
    )


@query(f"WITH {RUNS_CTE} SELECT type, topics, coherence FROM runs")
def project_columns(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).select("type", "topics", "coherence")


@query(f"""WITH {RUNS_CTE} SELECT type, CAST(topics AS INTEGER) AS topics, CAST(coherence AS FLOAT) AS coherence,
  TRY_CAST(alpha_str || CAST(topics AS VARCHAR) AS FLOAT) AS n_alpha FROM runs""")
def enforce_run_schema(spark: SparkSession, sf: str) -> DataFrame:
    """A prior that is not a number becomes null."""
    raw = runs(spark, sf).select(
        "type", F.col("topics").cast("string").alias("topics"), F.col("coherence").cast("string").alias("coherence"),
        F.concat("alpha_str", F.col("topics").cast("string")).alias("n_alpha"),
    )
    return R.enforce_run_schema(raw)


@query(f"""WITH {RUNS_CTE} SELECT text_sha256, 'n_alpha' AS column_name, 'float' AS expected, 'string' AS actual,
  alpha_str || CAST(topics AS VARCHAR) AS value FROM runs WHERE topics > 3""")
def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    raw = runs(spark, sf).select(
        "text_sha256", F.col("topics").cast("string").alias("topics"),
        F.when(F.col("topics") > 3, F.concat("alpha_str", F.col("topics").cast("string"))).otherwise(F.col("n_alpha").cast("string")).alias("n_alpha"),
    )
    return R.schema_violations(raw, "text_sha256")


@query(f"WITH {RUNS_CTE} SELECT l_orderkey, alpha_str, topics FROM runs")
def unwrap_singletons(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = runs(spark, sf).select("l_orderkey", F.array("alpha_str").alias("alpha_str"), F.array("topics").alias("topics"))
    return R.unwrap_singletons(wrapped, ["alpha_str", "topics"])


@query(f"""WITH {RUNS_CTE} SELECT l_orderkey, topics, perplexity AS per_word_bound,
  CASE WHEN topics IN (1, 2, 3, 4) THEN 0 ELSE coherence END AS coherence, round(pow(2, -perplexity), 6) AS _perplexity_ FROM runs""")
def repair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that are nan, infinite or no number at all by topic count."""
    t = F.col("topics")
    text = (
        F.when(t == 1, "nan").when(t == 2, "-inf").when(t == 3, "Infinity").when(t == 4, "failed")
        .otherwise(F.col("coherence").cast("string"))
    )
    rows = runs(spark, sf).select("l_orderkey", "topics", "perplexity", text.alias("coherence"))
    return rounded(R.repair_scores(R.rename_columns(rows)))


@query(f"""WITH {RUNS_CTE} SELECT l_orderkey, topics, 60 AS batch_size, 8 AS num_workers,
  CAST((SELECT count(*) FROM runs) AS INTEGER) AS num_documents FROM runs""")
def stamp_run_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf)
    return R.stamp_run_columns(rows.select("l_orderkey", "topics"), 60, 8, rows.agg(F.count("*")).scalar())


@query("""SELECT event_id, md5(strftime(ts, '%Y%m%d%H%M%S%f')) AS time_key, sha256(props) AS text_sha256, md5(props) AS text_md5,
  round(CAST(value AS DOUBLE), 3) AS elapsed FROM events""")
def run_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Events as runs that end `value` seconds after they start."""
    events = table(spark, sf, "events").withColumn(
        "end_ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000000).cast("bigint"))
    )
    rows = R.run_identity(events, "props", "ts", "end_ts")
    return rows.select("event_id", "time_key", "text_sha256", "text_md5", F.round("elapsed", 3).alias("elapsed"))


@query("""WITH u AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)
SELECT user_id, round((epoch_us(b) - epoch_us(a)) / 1e6, 2) AS seconds, round((epoch_us(b) - epoch_us(a)) / 1e6 / 60, 2) AS minutes FROM u""")
def elapsed_times(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    a, b = F.col("a"), F.col("b")
    return spans.select("user_id", F.round(X.elapsed_seconds(a, b), 2).alias("seconds"), X.elapsed_minutes(a, b).alias("minutes"))


@query(f"WITH {RUNS_CTE} SELECT l_orderkey, topics, coherence AS _coherence, perplexity AS per_word_bound FROM runs")
def rename_columns(spark: SparkSession, sf: str) -> DataFrame:
    return R.rename_columns(runs(spark, sf)).select("l_orderkey", "topics", "_coherence", "per_word_bound")


@query("""WITH d AS (SELECT doc_id, lang, 2013 + doc_id % 9 AS year, CASE WHEN doc_id % 3 = 0 THEN 'issue' ELSE 'article' END AS level FROM documents)
SELECT doc_id, lang, CAST(year AS INTEGER) AS year, level FROM d WHERE year BETWEEN 2015 AND 2019 AND lang IN ('en', 'EN') AND level = 'article'""")
def filter_articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", (F.col("doc_id") % 9 + 2013).cast("int").alias("year"),
        F.when(F.col("doc_id") % 3 == 0, "issue").otherwise("article").alias("level"),
    )
    return C.filter_articles(docs, range(2015, 2020))


@query("""SELECT doc_id, lang FROM documents WHERE text NOT IN (SELECT text FROM benchmark) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def exclude_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are on neither of two exclusion lists: benchmark texts and toxic ids."""
    docs = table(spark, sf, "documents", "doc_id", "lang", "text")
    kept = C.exclude_keys(docs, table(spark, sf, "benchmark"), "text", "text")
    toxic = table(spark, sf, "labels").filter("toxic = 1")
    return C.exclude_keys(kept, toxic, "doc_id", "doc_id").select("doc_id", "lang")


@query(f"WITH {RUNS_CTE} SELECT l_orderkey, topics, coherence FROM runs WHERE coherence > 0.07")
def filter_score(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).filter("coherence > 0.07").select("l_orderkey", "topics", "coherence")


@query(f"WITH {RUNS_CTE} SELECT l_orderkey, topics, type FROM runs WHERE type = 'O'")
def filter_split(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).filter(F.col("type") == EVAL).select("l_orderkey", "topics", "type")


@query(f"WITH {RUNS_CTE} SELECT l_orderkey, topics, type FROM runs WHERE topics = 5")
def filter_topic_count(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).filter("topics = 5").select("l_orderkey", "topics", "type")


# --- joins -----------------------------------------------------------------------------------------------------


@query("""SELECT d.doc_id, l.doc_id AS label_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def content_metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "label_id")
    return C.content_metadata_join(table(spark, sf, "documents", "doc_id", "lang"), labels, "doc_id", "label_id")


EXPLORE_CTE = RUNS_CTE + """,
b AS (SELECT text_sha256, count(*) AS sha_count FROM runs GROUP BY text_sha256 HAVING count(*) > 0),
c AS (SELECT DISTINCT type, topics, text_sha256, n_alpha, n_beta, count(*) OVER (PARTITION BY type, topics, n_alpha, n_beta) AS type_alpha_beta_count FROM runs),
joined AS (SELECT a.type, a.text_sha256 AS left_sha, c.text_sha256 AS right_sha, a.alpha_str, a.beta_str, c.topics, c.type_alpha_beta_count
  FROM runs a JOIN c ON a.type = c.type AND a.text_sha256 = c.text_sha256 AND a.n_beta = c.n_beta AND a.n_alpha = c.n_alpha
  JOIN b ON b.text_sha256 = c.text_sha256)"""


@query(f"""WITH {EXPLORE_CTE} SELECT *, count(*) OVER (PARTITION BY type, left_sha) AS sha_count,
  CAST(sum(type_alpha_beta_count) OVER (PARTITION BY type, left_sha) AS BIGINT) AS model_sum FROM joined""")
def explore_join(spark: SparkSession, sf: str) -> DataFrame:
    return R.explore_join(runs(spark, sf), ["l_orderkey", "topics"])


@query("""SELECT d.doc_id, l.quality = 1 AS create_pylda, l.toxic = 1 AS create_pcoa FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def attach_status(spark: SparkSession, sf: str) -> DataFrame:
    status = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("create_pylda"), (F.col("toxic") == 1).alias("create_pcoa")
    )
    return R.attach_status(table(spark, sf, "documents", "doc_id"), status, "doc_id")


AXES = ["topics", "alpha_str", "beta_str", "type"]
LEVELS_CTE = RUNS_CTE + """, grid AS (SELECT topics, alpha_str, beta_str, type FROM (SELECT DISTINCT topics FROM runs)
  CROSS JOIN (SELECT DISTINCT alpha_str FROM runs) CROSS JOIN (SELECT DISTINCT beta_str FROM runs) CROSS JOIN (SELECT DISTINCT type FROM runs))"""


@query(f"WITH {LEVELS_CTE} SELECT topics, alpha_str, beta_str, type FROM grid")
def hyperparameter_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All combinations of the levels seen in the runs."""
    return GR.grid_of_levels(runs(spark, sf), AXES)


@query(f"WITH {LEVELS_CTE} SELECT * FROM grid EXCEPT SELECT topics, alpha_str, beta_str, type FROM runs WHERE coherence >= 0.1")
def undrawn_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations without a single high-scoring run."""
    rows = runs(spark, sf)
    return GR.undrawn(GR.grid_of_levels(rows, AXES), rows.filter("coherence >= 0.1").select(*AXES).distinct())


@query(f"""WITH {LEVELS_CTE}, ranked AS (SELECT *, row_number() OVER (ORDER BY
    md5('{SEED}|' || topics || '|' || alpha_str || '|' || beta_str || '|' || type)) AS r, count(*) OVER () AS n FROM grid)
SELECT topics, alpha_str, beta_str, type FROM ranked WHERE r <= greatest(1, floor(n * CAST(0.375 AS DOUBLE)))""")
def sample_grid(spark: SparkSession, sf: str) -> DataFrame:
    return GR.sample_grid(GR.grid_of_levels(runs(spark, sf), AXES), AXES, SEED)


@query(f"""WITH ranked AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY
    md5('{SEED}|' || CAST(event_id AS VARCHAR)), event_id) AS r FROM events),
least_n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM events GROUP BY event_type))
SELECT event_type, event_id FROM ranked, least_n WHERE r <= n""")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return GR.balanced_sample(table(spark, sf, "events", "event_type", "event_id"), "event_type", "event_id", SEED)


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_retailprice AS score FROM part),
s AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_acctbal AS score FROM customer)
SELECT i, p.score AS score_1, s.score AS score_2 FROM p JOIN s USING (i)""")
def pair_models(spark: SparkSession, sf: str) -> DataFrame:
    """The i-th part beside the i-th customer."""
    parts = row_index(table(spark, sf, "part", "p_partkey", F.col("p_retailprice").alias("score")), [F.col("p_partkey")], "i")
    others = row_index(table(spark, sf, "customer", "c_custkey", F.col("c_acctbal").alias("score")), [F.col("c_custkey")], "i")
    return R.pair_models(parts.select("i", "score"), others.select("i", "score"), "i")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS left_pos FROM documents),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS right_pos FROM labels)
SELECT doc_id, left_pos, right_pos, left_pos IS NOT DISTINCT FROM right_pos AS consistent FROM a FULL JOIN b USING (doc_id)""")
def keys_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return C.keys_consistent(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", ["doc_id"])


# --- univariate statistics and tables ----------------------------------------------------------------------------


@query(f"""WITH {LONG_CTE} SELECT type, text_sha256, variable, count(value) AS n, round(1e-9 + sum(value), 6) AS sum, round(1e-9 + avg(value), 6) AS mean,
  round(1e-9 + stddev_samp(value), 6) AS std, round(1e-9 + var_samp(value), 6) AS variance, round(1e-9 + skewness(value), 6) AS skewness,
  round(1e-9 + kurtosis(value), 6) AS kurtosis, round(1e-9 + sum(value * value), 6) AS uss, round(1e-9 + var_samp(value) * (count(value) - 1), 6) AS css,
  round(1e-9 + stddev_samp(value) / avg(value) * 100, 6) AS cv, round(1e-9 + stddev_samp(value) / sqrt(count(value)), 6) AS std_error
FROM v GROUP BY type, text_sha256, variable""")
def univariate_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Values that end exactly in half a unit of the last digit shown are lifted off it, so that both engines round them alike."""
    moments = ST.moments(fixed_runs(spark, sf), ["type", "text_sha256"], VARS)
    return rounded(moments.select(*[(F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in moments.dtypes]))


def quantile_sql(q: int) -> str:
    lo = f"greatest(CASE WHEN n * {q} % 100 = 0 THEN n * {q} // 100 ELSE n * {q} // 100 + 1 END, 1)"
    hi = f"least(n * {q} // 100 + 1, n)"
    return f"(max(CASE WHEN r = {lo} THEN value END) + max(CASE WHEN r = {hi} THEN value END)) / 2 AS p{q}"


@query(f"""WITH {LONG_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY type, text_sha256, variable ORDER BY value) AS r,
    count(*) OVER (PARTITION BY type, text_sha256, variable) AS n FROM v),
q AS (SELECT type, text_sha256, variable, {", ".join(quantile_sql(q) for q in ST.QUANTILES)}, max(value) - min(value) AS range FROM r GROUP BY type, text_sha256, variable),
c AS (SELECT type, text_sha256, variable, value, count(*) AS k FROM v GROUP BY ALL),
m AS (SELECT type, text_sha256, variable, value, row_number() OVER (PARTITION BY type, text_sha256, variable ORDER BY k DESC, value) AS place FROM c)
SELECT type, text_sha256, variable, {", ".join(f"round(p{q}, 6) AS p{q}" for q in ST.QUANTILES)}, round(range, 6) AS range, round(p75 - p25, 6) AS iqr, round(m.value, 6) AS mode FROM q JOIN m USING (type, text_sha256, variable) WHERE m.place = 1""")
def univariate_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.quantiles(fixed_runs(spark, sf), ["type", "text_sha256"], VARS))


@query(f"""WITH {LONG_CTE.replace("type, text_sha256,", "type, text_sha256, l_orderkey,")},
lo AS (SELECT type, text_sha256, variable, value, l_orderkey, 'low' AS side, row_number() OVER (PARTITION BY type, text_sha256, variable ORDER BY value, l_orderkey) AS place FROM v),
hi AS (SELECT type, text_sha256, variable, value, l_orderkey, 'high' AS side, row_number() OVER (PARTITION BY type, text_sha256, variable ORDER BY value DESC, l_orderkey DESC) AS place FROM v)
SELECT type, text_sha256, variable, side, CAST(place AS INTEGER) AS place, round(value, 6) AS value, l_orderkey FROM lo WHERE place <= 5
UNION ALL SELECT type, text_sha256, variable, side, CAST(place AS INTEGER), round(value, 6), l_orderkey FROM hi WHERE place <= 5""")
def univariate_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.extremes(fixed_runs(spark, sf), ["type", "text_sha256"], VARS, "l_orderkey"))


@query(f"""WITH {LONG_CTE}, s AS (SELECT type, text_sha256, variable, count(*) AS n, avg(value) / (stddev_samp(value) / sqrt(count(*))) AS t,
    CAST(count(*) FILTER (value > 0) - count(*) FILTER (value < 0) AS DOUBLE) / 2 AS m FROM v GROUP BY type, text_sha256, variable),
r AS (SELECT type, text_sha256, variable, value, rank() OVER w + (count(*) OVER (PARTITION BY type, text_sha256, variable, abs(value)) - 1) / 2 AS avg_rank,
    count(*) OVER (PARTITION BY type, text_sha256, variable) AS nt FROM v WHERE value <> 0
    WINDOW w AS (PARTITION BY type, text_sha256, variable ORDER BY abs(value))),
g AS (SELECT type, text_sha256, variable, sum(CASE WHEN value > 0 THEN avg_rank ELSE 0 END) - max(nt) * (max(nt) + 1) / 4 AS sr FROM r GROUP BY type, text_sha256, variable)
SELECT type, text_sha256, variable, n, round(t, 6) AS student_t, m AS sign_m, round(coalesce(sr, 0), 6) AS signed_rank_s FROM s LEFT JOIN g USING (type, text_sha256, variable)""")
def univariate_location(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.location_tests(fixed_runs(spark, sf), ["type", "text_sha256"], VARS))


@query(f"""WITH {RUNS_CTE}, g AS (SELECT text_sha256, CASE WHEN coherence > 0 THEN coherence END AS coherence, CASE WHEN topics < 7 THEN perplexity END AS perplexity FROM runs)
SELECT text_sha256, 'coherence' AS variable, count(*) AS n_obs, count(*) - count(coherence) AS n_missing, round((count(*) - count(coherence)) * 100.0 / count(*), 6) AS pct_missing FROM g GROUP BY text_sha256
UNION ALL SELECT text_sha256, 'perplexity', count(*), count(*) - count(perplexity), round((count(*) - count(perplexity)) * 100.0 / count(*), 6) FROM g GROUP BY text_sha256""")
def univariate_missing(spark: SparkSession, sf: str) -> DataFrame:
    gaps = runs(spark, sf).select(
        "text_sha256",
        F.when(F.col("coherence") > 0, F.col("coherence")).alias("coherence"),
        F.when(F.col("topics") < 7, F.col("perplexity")).alias("perplexity"),
    )
    return rounded(ST.missing_values(gaps, ["text_sha256"], ["coherence", "perplexity"]))


def crosstab_sql(group: list[str], row: str, col: str, where: str) -> str:
    g = ", ".join(group)
    return f"""cells AS (SELECT {g}, {row}, {col}, count(*) AS f FROM runs WHERE {where} GROUP BY ALL),
tot AS (SELECT {g}, sum(f) AS t FROM cells GROUP BY ALL),
rt AS (SELECT {g}, {row}, sum(f) AS r FROM cells GROUP BY ALL), ct AS (SELECT {g}, {col}, sum(f) AS k FROM cells GROUP BY ALL),
everything AS (
SELECT {g}, {row}, {col}, 'cell' AS kind, f, t, r, k FROM cells JOIN tot USING ({g}) JOIN rt USING ({g}, {row}) JOIN ct USING ({g}, {col})
UNION ALL SELECT {g}, {row}, NULL, 'row_total', r, t, NULL, NULL FROM rt JOIN tot USING ({g})
UNION ALL SELECT {g}, NULL, {col}, 'col_total', k, t, NULL, NULL FROM ct JOIN tot USING ({g})
UNION ALL SELECT {g}, NULL, NULL, 'total', t, t, NULL, NULL FROM tot)
SELECT {g}, {row}, {col}, kind, CAST(f AS BIGINT) AS frequency, round(CAST(f AS DOUBLE) * 100 / t, 6) AS percent,
  round(CAST(f AS DOUBLE) * 100 / r, 6) AS row_pct, round(CAST(f AS DOUBLE) * 100 / k, 6) AS col_pct FROM everything"""


@query(f"WITH {RUNS_CTE}, {crosstab_sql(['type', 'text_sha256'], 'alpha_str', 'beta_str', 'true')}")
def crosstab_labels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.crosstab(runs(spark, sf), ["type", "text_sha256"], "alpha_str", "beta_str"))


@query(f"WITH {RUNS_CTE}, {crosstab_sql(['type', 'text_sha256'], 'n_alpha', 'n_beta', 'true')}")
def crosstab_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.crosstab(runs(spark, sf), ["type", "text_sha256"], "n_alpha", "n_beta"))


@query(f"WITH {RUNS_CTE}, {crosstab_sql(['type', 'text_sha256', 'topics'], 'alpha_str', 'beta_str', 'true')}")
def crosstab_by_topics(spark: SparkSession, sf: str) -> DataFrame:
    """One alpha by beta table per type, text and number of topics."""
    return rounded(ST.crosstab(runs(spark, sf), ["type", "text_sha256"], "alpha_str", "beta_str", ["topics"]))


@query(f"WITH {RUNS_CTE} SELECT text_sha256, count(*) AS sha_count FROM runs GROUP BY text_sha256")
def count_per_text(spark: SparkSession, sf: str) -> DataFrame:
    return R.count_per_text(runs(spark, sf))


@query(f"WITH {EXPLORE_CTE} SELECT type, topics, text_sha256, n_alpha, n_beta, type_alpha_beta_count FROM c")
def count_per_model(spark: SparkSession, sf: str) -> DataFrame:
    return R.count_per_model(R.combination_counts(runs(spark, sf)))


@query(f"""WITH {RUNS_CTE}, c AS (SELECT type, topics, coherence, count(*) AS k FROM runs GROUP BY ALL),
m AS (SELECT type, topics, coherence, row_number() OVER (PARTITION BY type, topics ORDER BY k DESC, coherence) AS place FROM c)
SELECT r.type, r.topics, round(avg(r.coherence), 6) AS score_mean, round(max(m.coherence), 6) AS score_mode,
  round(median(r.coherence), 6) AS score_median, round(stddev_pop(r.coherence), 6) AS score_std
FROM runs r JOIN m ON r.type = m.type AND r.topics = m.topics AND m.place = 1 GROUP BY r.type, r.topics""")
def coherence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.score_summary(runs(spark, sf), ["type", "topics"], "coherence"))


ORDER_SQL = ", ".join(f'"{c}"' for c in RUN_ORDER)


@query(f"""WITH {RUNS_CTE}, i AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS index FROM runs)
SELECT type, topics, index, coherence FROM i WHERE coherence > 0.08""")
def score_series(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the score chart: runs above the threshold by topics and row number."""
    indexed = row_index(runs(spark, sf), [F.col(c) for c in RUN_ORDER])
    return indexed.filter("coherence > 0.08").select("type", "topics", "index", "coherence")


@query(f"WITH {RUNS_CTE} SELECT DISTINCT type, topics, alpha_str, beta_str, text_sha256 FROM runs")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).select("type", "topics", "alpha_str", "beta_str", "text_sha256").distinct()


# --- windows, sorts, limits, sets --------------------------------------------------------------------------------


@query(f"""WITH {RUNS_CTE} SELECT l_orderkey, topics, type, text_sha256, count(*) OVER (PARTITION BY type, text_sha256) AS sha_count,
  CAST(sum(topics) OVER (PARTITION BY type, text_sha256) AS BIGINT) AS topic_sum FROM runs""")
def group_remerge(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf).select("l_orderkey", "topics", "type", "text_sha256")
    aggs = {"sha_count": F.count("*"), "topic_sum": F.sum("topics")}
    return R.group_remerge(rows, ["type", "text_sha256"], aggs, ["l_orderkey"])


@query(f"""WITH {RUNS_CTE} SELECT l_orderkey, topics, l_partkey, row_number() OVER (ORDER BY {ORDER_SQL}) AS index FROM runs""")
def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return row_index(runs(spark, sf), [F.col(c) for c in RUN_ORDER]).select("l_orderkey", "topics", "l_partkey", "index")


@query(f"WITH {RUNS_CTE} SELECT type, text_sha256, topics, alpha_str, beta_str, coherence FROM runs ORDER BY text_sha256, topics, alpha_str, beta_str, type")
def sort_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf).select("type", "text_sha256", "topics", "alpha_str", "beta_str", "coherence")
    return rows.orderBy("text_sha256", "topics", "alpha_str", "beta_str", "type")


@query(f"""WITH {RUNS_CTE}, r AS (SELECT text_sha256, coherence, topics, l_orderkey, l_partkey,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY coherence DESC, l_orderkey DESC, topics DESC, l_partkey DESC) AS place FROM runs)
SELECT text_sha256, coherence, topics, l_orderkey, l_partkey FROM r WHERE place = 1""")
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf).select("text_sha256", "coherence", "topics", "l_orderkey", "l_partkey")
    return R.best_model(rows, ["text_sha256"], "coherence", ["l_orderkey", "topics", "l_partkey"])


@query(f"WITH {RUNS_CTE} SELECT l_orderkey, topics, l_partkey, coherence FROM runs ORDER BY {ORDER_SQL} LIMIT 500")
def head(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 runs."""
    return runs(spark, sf).orderBy(*RUN_ORDER).limit(500).select("l_orderkey", "topics", "l_partkey", "coherence")


@query("""WITH p AS (SELECT doc_id AS key, 0 AS load_order, lang AS content FROM documents UNION ALL SELECT doc_id, 1, 'label ' || CAST(quality AS VARCHAR) FROM labels)
SELECT key, arg_max(content, load_order) AS content FROM p GROUP BY key""")
def merge_collections(spark: SparkSession, sf: str) -> DataFrame:
    """Later collections overwrite earlier ones key by key."""
    first = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.lit(0).alias("load_order"), F.col("lang").alias("content"))
    second = table(spark, sf, "labels").select(
        F.col("doc_id").alias("key"), F.lit(1).alias("load_order"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("content")
    )
    return C.merge_collections(first, second, key="key")


@query(f"""WITH {RUNS_CTE} SELECT type, topics, coherence, NULL AS beta_str FROM runs WHERE type = 'F'
UNION ALL SELECT type, topics, NULL, beta_str FROM runs WHERE type = 'O'""")
def concat_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf)
    return R.concat_runs(
        rows.filter(F.col("type") == TRAIN).select("type", "topics", "coherence"),
        rows.filter(F.col("type") == EVAL).select("type", "topics", "beta_str"),
    )


@query(f"""WITH {RUNS_CTE} SELECT type, topics, coherence FROM runs WHERE type = 'F' UNION SELECT type, topics, coherence FROM runs WHERE type = 'O'""")
def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf).select("type", "topics", "coherence")
    return R.union_splits(rows.filter(F.col("type") == TRAIN), rows.filter(F.col("type") == EVAL))


# --- priors ------------------------------------------------------------------------------------------------------

LABEL_CTE = RUNS_CTE + """, labels_ AS (SELECT l_orderkey, topics, CASE topics WHEN 1 THEN 'symmetric' WHEN 2 THEN 'asymmetric' WHEN 3 THEN 'wrong' ELSE beta_str END AS label FROM runs)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("topics")
    label = F.when(t == 1, "symmetric").when(t == 2, "asymmetric").when(t == 3, "wrong").otherwise(F.col("beta_str"))
    return runs(spark, sf).select("l_orderkey", "topics", label.alias("label"))


@query(f"""WITH {LABEL_CTE} SELECT l_orderkey, topics, label,
  round(CASE label WHEN 'symmetric' THEN 1.0::DOUBLE / 21 WHEN 'asymmetric' THEN 1.0::DOUBLE / (21 + sqrt(21)) ELSE TRY_CAST(label AS DOUBLE) END, 9) AS n_alpha,
  round(CASE label WHEN 'symmetric' THEN 1.0::DOUBLE / 21 ELSE TRY_CAST(label AS DOUBLE) END, 9) AS n_beta FROM labels_""")
def numeric_priors(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label")
    return rounded(
        labelled(spark, sf).select(
            "l_orderkey", "topics", "label",
            P.numeric_alpha(label).cast("double").alias("n_alpha"), P.numeric_beta(label).cast("double").alias("n_beta"),
        ),
        9,
    )


@query(f"WITH {LABEL_CTE} SELECT l_orderkey, topics, label FROM labels_ WHERE label = 'wrong'")
def invalid_priors(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).filter(~P.prior_is_valid(F.col("label")))


@query(f"WITH {RUNS_CTE} SELECT l_orderkey, topics, CAST(n_alpha AS VARCHAR) AS alpha_label, CAST(n_beta AS VARCHAR) AS beta_label FROM runs")
def prior_labels(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).select(
        "l_orderkey", "topics", P.prior_label(F.col("n_alpha")).alias("alpha_label"), P.prior_label(F.col("n_beta")).alias("beta_label")
    )
