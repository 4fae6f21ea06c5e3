"""Queries that fit and judge topic models; checked by invariants, because SQL cannot fit a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch_models as B
from ..operators import coherence as CO
from ..operators import corpus_models as CM
from ..operators import corpus as C
from ..operators import dictionary as D
from ..operators import geometry as G
from ..operators import grid as GR
from ..operators import online as ON
from ..operators import runs as R
from ..operators import splits as S
from ..operators import stats as ST
from ..operators import topic_models as TM
from ..runtime import materialize
from .catalog import BATCH_CTE, SEED, TOK_CTE, WORDS_CTE, documents, query, rounded, token_table

K, ALPHA, ETA, PASSES = 5, 0.2, 0.2, TM.PASSES  # as many passes as the reference makes


GRID_TOPICS, GRID_DECAYS, FOLDS, GRID_PASSES = [3, K], [0.5, 0.7, 0.9], 10, 5


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, packed for the corpus models."""
    return CM.pack(documents(spark, sf))


def corpus_model(spark: SparkSession, sf: str) -> TM.TopicModel:
    return TM.fit_topics(corpus(spark, sf), K, ALPHA, ETA, passes=PASSES)


# Each token's expected counts add up to one, so a term's weights add up to its count and its priors, whatever the fit.
@query(f"""
WITH {WORDS_CTE}
SELECT term, round(count(*) + {K} * CAST({ETA} AS DOUBLE), 4) AS weight, CAST({K} AS BIGINT) AS n_topics FROM words GROUP BY term""")
def fit_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of all documents in the fitted model: the sum of its topic weights and the number of its topics."""
    rows = corpus_model(spark, sf).topic_rows().groupBy("term")
    return rounded(rows.agg(F.sum("weight").alias("weight"), F.count("*").alias("n_topics")), 4)


@query()
def fitted_top_words(spark: SparkSession, sf: str) -> DataFrame:
    """Ten strongest words of each topic."""
    return corpus_model(spark, sf).topic_words(10)


@query(f"""
WITH {WORDS_CTE}, n AS (SELECT count(DISTINCT term) AS n_terms FROM words)
SELECT CAST(t AS INTEGER) AS topic, n_terms, CAST(1 AS DOUBLE) AS phi_sum FROM n, unnest(range({K})) AS r(t)""")
def fitted_topic_word_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the fitted topic-word matrix: every topic spreads a probability of 1 over every term."""
    phi = G.topic_word_matrix(corpus_model(spark, sf).topic_rows())
    return rounded(phi.groupBy("topic").agg(F.count("*").alias("n_terms"), F.sum("phi").alias("phi_sum")))


def split_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.split_train_eval(token_table(spark, sf), "doc_id", SEED)
    train, held_out = (CM.pack(docs.filter(F.col("split") == x)) for x in ("train", "eval"))
    model = TM.fit_topics(train, K, ALPHA, ETA, passes=PASSES)
    return model.scores(train).withColumn("split", F.lit("train")).unionByName(model.scores(held_out).withColumn("split", F.lit("eval")))


@query(f"""
WITH {BATCH_CTE}, w AS (SELECT split, doc_id, unnest(tokens) AS term FROM batches),
known AS (SELECT DISTINCT term FROM w WHERE split = 'train')
SELECT split, (SELECT count(*) FROM batches b WHERE b.split = w.split) AS n_docs, count(*) AS n_tokens, true AS below_zero, true AS is_power
FROM w SEMI JOIN known USING (term) GROUP BY split""")
def model_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and known words that the bounds of training and held-out documents rest on, and the signs of the bounds."""
    power = F.abs(F.log2("perplexity_base2") + F.col("per_word_bound")) < 1e-9
    return split_scores(spark, sf).select("split", "n_docs", "n_tokens", (F.col("bound") < 0).alias("below_zero"), power.alias("is_power"))


@query()
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Bound and perplexity on the training documents and on the held-out ones."""
    return split_scores(spark, sf)


@query(f"""
WITH {TOK_CTE}
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST({K} AS INTEGER) AS n_topics, CAST(1 AS DOUBLE) AS share_sum FROM tok""")
def doc_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Every document has its words inferred and a share in every topic, adding up to 1."""
    packed = corpus(spark, sf)
    shares = TM.fit_topics(packed, K, ALPHA, ETA, passes=PASSES).doc_topics(packed)
    total = F.aggregate("distribution", F.lit(0.0), lambda a, x: a + x)
    return rounded(shares.select("doc_id", "n_tokens", F.size("distribution").alias("n_topics"), total.alias("share_sum")))


@query()
def doc_topic_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Topic shares of all documents, as one row per document and topic."""
    packed = corpus(spark, sf)
    shares = TM.fit_topics(packed, K, ALPHA, ETA, passes=PASSES).doc_topics(packed)
    return shares.select("doc_id", F.posexplode("distribution").alias("topic", "share"))


def searched(spark: SparkSession, sf: str) -> DataFrame:
    return CM.grid_search(documents(spark, sf), GRID_TOPICS, [ALPHA], [ETA], decays=GRID_DECAYS, folds=FOLDS, passes=GRID_PASSES)


@query(f"""
WITH n AS (SELECT count(*) AS n_docs FROM documents)
SELECT CAST(k AS INTEGER) AS k, CAST({ALPHA} AS DOUBLE) AS alpha, CAST({ETA} AS DOUBLE) AS eta, CAST(decay AS DOUBLE) AS decay,
  CAST({FOLDS} AS BIGINT) AS n_splits, n_docs, true AS scored
FROM n, unnest({GRID_TOPICS}) AS a(k), unnest({GRID_DECAYS}) AS b(decay)""")
def grid_search_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Every grid point is scored on every fold, and the folds make up all documents."""
    scored = F.bool_and((F.col("score") < 0) & (F.col("train_score") < 0))
    rows = searched(spark, sf).groupBy("k", "alpha", "eta", "decay")
    return rows.agg(F.count("*").alias("n_splits"), F.sum("n_test").alias("n_docs"), scored.alias("scored"))


@query()
def grid_search_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Topic counts and decay rates compared over ten folds."""
    return TM.best_point(searched(spark, sf))


GRID = {"topics": [3, K], "alpha_str": ["symmetric"], "beta_str": ["0.31"], "gamma": [0.001, 0.004], "type": ["eval", "train"]}
BATCH_PASSES = 3


def drawn_grid(spark: SparkSession) -> DataFrame:
    return GR.sample_grid(GR.product(spark, GRID), list(GRID), SEED)


def batch_fits(spark: SparkSession, sf: str, passes: int = BATCH_PASSES, **settings) -> tuple[DataFrame, DataFrame]:
    """Fits of every drawn combination on every batch of all documents, and the text hashes of the batches."""
    batches = materialize(S.assign_batches(C.drop_empty(token_table(spark, sf)), "doc_id", SEED), "batches")
    fits = B.fit_per_batch(batches, drawn_grid(spark), passes=passes, **settings)
    return materialize(fits, "fits"), D.batch_fingerprint(batches, ["split", "batch_id"], "pos")


# Batches of the documents that have words, and the drawn part of the grid.
FIT_CTE = f"""{BATCH_CTE.replace("FROM tok)", "FROM tok WHERE len(tokens) > 0)")},
grid AS (SELECT CAST(topics AS INTEGER) AS topics, alpha_str, beta_str, CAST(gamma AS DOUBLE) AS gamma, drawn_type
  FROM unnest({GRID["topics"]}) AS a(topics), unnest({GRID["alpha_str"]}) AS b(alpha_str), unnest({GRID["beta_str"]}) AS c(beta_str),
  unnest({GRID["gamma"]}) AS d(gamma), unnest({GRID["type"]}) AS e(drawn_type)),
places AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || k), k) AS place, count(*) OVER () AS n
  FROM (SELECT *, topics || '|' || alpha_str || '|' || beta_str || '|' || gamma || '|' || drawn_type AS k FROM grid)),
drawn AS (SELECT topics, alpha_str, beta_str, gamma, drawn_type FROM places WHERE place <= greatest(1, floor(n * 0.375))),
sizes AS (SELECT split, batch_id, CAST(count(*) AS INTEGER) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM batches GROUP BY 1, 2)"""


@query(f"""
WITH {FIT_CTE}
SELECT split, batch_id, CAST(0 AS INTEGER) AS step, topics, alpha_str, beta_str, gamma, drawn_type, n_docs, n_tokens,
  CAST(n_docs // 5 AS INTEGER) AS chunksize, topics AS n_topics, true AS scored FROM sizes, drawn""")
def fit_topics_per_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One fit for each drawn combination and batch, with the sizes it rests on."""
    fits, _ = batch_fits(spark, sf)
    scored = (F.col("convergence") < 0) & (F.col("perplexity") < 0) & F.col("coherence").between(-1, 1)
    return fits.select(*B.run_key_columns(), "n_docs", "n_tokens", "chunksize", F.size("top_words").alias("n_topics"), scored.alias("scored"))


@query()
def batch_fit_scores(spark: SparkSession, sf: str) -> DataFrame:
    fits, _ = batch_fits(spark, sf)
    return fits.select(*B.run_key_columns(), "n_docs", "n_tokens", "convergence", "perplexity", "coherence")


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    fits, fingerprints = batch_fits(spark, sf)
    n = fits.select(F.count("*")).scalar()
    rows = B.train_run_rows(fits, fingerprints, S.BATCH_SIZE, WORKERS, 0, passes=BATCH_PASSES)
    return R.stamp_run_columns(rows, S.BATCH_SIZE, WORKERS, n)


WORKERS = 8  # a stamp on the rows, as the reference configures it; how many tasks run is the cluster's matter


@query(f"""
WITH {FIT_CTE},
texts AS (SELECT split, batch_id, string_agg(array_to_string(tokens, ' '), ' ' ORDER BY pos) AS text FROM batches GROUP BY 1, 2),
rows AS (SELECT split AS type, sha256(text) AS text_sha256, md5(text) AS text_md5, topics, alpha_str, beta_str, CAST(n_docs // 5 AS INTEGER) AS chunksize
  FROM sizes JOIN texts USING (split, batch_id), drawn)
SELECT type, text_sha256, text_md5, topics, alpha_str, beta_str, chunksize, CAST({S.BATCH_SIZE} AS INTEGER) AS batch_size, CAST({WORKERS} AS INTEGER) AS num_workers,
  CAST((SELECT count(*) FROM rows) AS INTEGER) AS num_documents, CAST({BATCH_PASSES} AS INTEGER) AS passes, topics AS n_topics, true AS has_key FROM rows""")
def train_run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Run-table rows of all batch models: every column that does not hang on the fit's numbers."""
    exact = ["type", "text_sha256", "text_md5", "topics", "alpha_str", "beta_str", "chunksize", "batch_size", "num_workers", "num_documents", "passes"]
    return run_rows(spark, sf).select(*exact, F.size("top_words").alias("n_topics"), (F.length("time_key") == 32).alias("has_key"))


@query()
def train_run_table(spark: SparkSession, sf: str) -> DataFrame:
    """Run-table rows of all batch models, with the nested word lists as text."""
    return run_rows(spark, sf).withColumn("top_words", F.to_json("top_words"))


@query()
def fitted_topic_map(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 most relevant terms of each topic of the fitted corpus model, with topic shares weighted by document length."""
    packed = corpus(spark, sf)
    model = TM.fit_topics(packed, K, ALPHA, ETA, passes=PASSES)
    shares = model.doc_topics(packed).select("n_tokens", F.posexplode("distribution").alias("topic", "theta"))
    phi = materialize(G.topic_word_matrix(model.topic_rows()), "phi")
    return G.relevance(phi, materialize(G.topic_shares(shares), "shares"))


@query()
def fitted_per_word_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics of every term of the fitted corpus model by p(topic | term)."""
    packed = corpus(spark, sf)
    model = TM.fit_topics(packed, K, ALPHA, ETA, passes=PASSES)
    shares = model.doc_topics(packed).select("n_tokens", F.posexplode("distribution").alias("topic", "theta"))
    phi = materialize(G.topic_word_matrix(model.topic_rows()), "phi")
    return G.per_word_topics(phi, materialize(G.topic_shares(shares), "shares"))


@query()
def batch_topic_map(spark: SparkSession, sf: str) -> DataFrame:
    """Two-axis map of the documents of each batch model, from their fitted topic shares."""
    fits, _ = batch_fits(spark, sf)
    return G.pcoa_2d(B.doc_topic_rows(fits), B.run_key_columns(), "doc_id")


@query()
def fit_per_document(spark: SparkSession, sf: str) -> DataFrame:
    """One model per document."""
    docs = C.drop_empty(documents(spark, sf))
    grid = GR.product(spark, {"topics": [2], "alpha_str": ["symmetric"], "beta_str": ["symmetric"]})
    fits = B.fit_per_document(docs, grid, passes=2)
    return fits.select(F.col("batch_id").alias("doc_id"), "topics", "n_tokens", "convergence", "perplexity", "coherence")


@query()
def fit_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Models on the first 25 and on all documents of each batch, with the coherence summary per batch."""
    fits, _ = batch_fits(spark, sf, passes=2, step_size=25)
    summary = ST.score_summary(fits, ["split", "batch_id", "topics"], "coherence")
    return rounded(summary)


@query()
def coherence_of_fits(spark: SparkSession, sf: str) -> DataFrame:
    """c_v of the words of a fitted model over the whole corpus."""
    topics = materialize(corpus_model(spark, sf).topic_words(20).withColumnRenamed("place", "place_in_topic"), "topics")
    return rounded(CO.coherence_cv(documents(spark, sf), topics))


YEARS = [2015, 2016, 2017]
MODEL = CM.Model(K, ALPHA, ETA)


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with words and a stand-in year, written once for the passes over each year."""
    docs = C.drop_empty(documents(spark, sf))
    return materialize(docs.withColumn("year", (F.col("doc_id") % 3 + 2015).cast("int")), "yearly")


@query()
def update_topics(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted on one year and updated with two more; twenty words per topic."""
    weights = ON.fit_yearly(yearly(spark, sf), YEARS, MODEL, passes=2)
    return G.top_words(G.topic_word_matrix(CM.topic_rows(weights, [MODEL])).withColumnRenamed("phi", "weight"), 20)


@query(f"""
WITH {TOK_CTE}, d AS (SELECT doc_id % 3 + 2015 AS year, len(tokens) AS n FROM tok WHERE len(tokens) > 0)
SELECT CAST(year AS INTEGER) AS year, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, true AS below_zero FROM d GROUP BY year""")
def yearly_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and words that each year's bound under the updated model rests on."""
    docs = yearly(spark, sf)
    scores = CM.document_topics(CM.pack(docs), ON.fit_yearly(docs, YEARS, MODEL), [MODEL]).join(docs.select("doc_id", "year"), "doc_id")
    below = F.bool_and(F.col("per_word_bound") < 0)
    return scores.groupBy("year").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), below.alias("below_zero"))


@query()
def mean_doc_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Mean per-document per-word bound of each year under the updated model."""
    docs = yearly(spark, sf)
    scores = CM.document_topics(CM.pack(docs), ON.fit_yearly(docs, YEARS, MODEL), [MODEL])
    return scores.join(docs.select("doc_id", "year"), "doc_id").groupBy("year").agg(
        F.avg("per_word_bound").alias("mean_doc_bound"), F.count("*").alias("n_docs")
    )


@query()
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    """Two settings of the learning offset side by side, for two topic counts: score against mean bound."""
    docs = yearly(spark, sf)
    packed = CM.pack(docs)

    def family(offset: float) -> DataFrame:
        rows = None
        for i, k in enumerate((3, K)):
            model = CM.Model(k, ALPHA, ETA, offset=offset)
            row = ON.mean_doc_bound(CM.document_topics(packed, ON.fit_yearly(docs, YEARS, model), [model])).withColumn("ordinal", F.lit(i))
            rows = row if rows is None else rows.unionByName(row)
        return rows

    return R.pair_models(family(1.0), family(10.0), "ordinal")
