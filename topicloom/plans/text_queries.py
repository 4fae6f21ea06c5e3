"""Queries over documents: tokens, dictionaries, phrases, splits, word tables, coherence counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import priors as P
from ..functions import scalars as X
from ..functions import text as TX
from ..operators import coherence as CO
from ..operators import corpus as C
from ..operators import dictionary as D
from ..operators import geometry as G
from ..operators import grid as GR
from ..operators import phrases as PH
from ..operators import ranking as RK
from ..operators import splits as S
from ..operators.shape import unnest
from ..runtime import materialize, spread
from .catalog import BATCH_CTE, SEED, TOK_CTE, WORDS_CTE, documents, query, rounded, table, token_table


def sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(f"""WITH {WORDS_CTE}
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM words WHERE lang = 'en' GROUP BY term""")
def english_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.term_counts(documents(spark, sf, lang="en"))


@query(f"""WITH {TOK_CTE}
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS joined FROM tok""")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"), TX.join_tokens(F.col("tokens")).alias("joined"))


@query(f"""WITH {TOK_CTE}
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens FROM tok WHERE len(tokens) > 0""")
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_empty(documents(spark, sf)).select("doc_id", F.size("tokens").alias("n_tokens"))


@query(f"""WITH {TOK_CTE} SELECT CAST(sum(len(tokens)) AS BIGINT) AS n_tokens,
  CAST(sum(len(string_split(array_to_string(tokens, ' '), ' '))) AS BIGINT) AS n_joined, true AS equal
FROM tok WHERE len(tokens) > 0""")
def token_total_check(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens counted before and after joining and splitting the text."""
    docs = C.drop_empty(documents(spark, sf))
    n = docs.agg(
        F.sum(F.size("tokens")).alias("n_tokens"),
        F.sum(F.size(TX.split_blank(TX.join_tokens(F.col("tokens"))))).alias("n_joined"),
    )
    return n.withColumn("equal", F.col("n_tokens") == F.col("n_joined"))


HTML_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
  '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"""


@query(rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace({HTML_SQL},
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
  '[ \t\r\n\f]+', ' ', 'g')) AS content FROM pages""")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", TX.html_to_text(F.col("html")).alias("content"))


@query(r"""WITH parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+[ \t\r\n\f]+|[\r\n]+')) AS raw FROM documents),
clean AS (SELECT doc_id, trim(regexp_replace(raw, '[ \t\r\n\f]+', ' ', 'g')) AS sentence FROM parts)
SELECT doc_id, sentence FROM clean WHERE len(list_filter(string_split(sentence, ' '), lambda w: w <> '')) >= 6""")
def sentences_min_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents", "doc_id", "text"))
    return unnest(docs, ["doc_id"], TX.sentences(F.col("text"), 6), "sentence")


@query(f"""WITH {WORDS_CTE}
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df, row_number() OVER (ORDER BY term) - 1 AS term_id
FROM words GROUP BY term""")
def build_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return D.build_dictionary(documents(spark, sf))


@query(f"""WITH {BATCH_CTE}, w AS (SELECT split, batch_id, doc_id, unnest(tokens) AS term FROM batches)
SELECT split, batch_id, term, count(*) AS cf, count(DISTINCT doc_id) AS df,
  row_number() OVER (PARTITION BY split, batch_id ORDER BY term) - 1 AS term_id FROM w GROUP BY split, batch_id, term""")
def batch_dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    return D.build_dictionary(S.assign_batches(documents(spark, sf), "doc_id", SEED), ["split", "batch_id"])


BOW_SQL = f"""WITH {WORDS_CTE}, dict AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id
  FROM words WHERE lang = 'en' GROUP BY term)
SELECT doc_id, term_id, count(*) AS n FROM words JOIN dict USING (term) GROUP BY doc_id, term_id"""


@query(BOW_SQL)
def doc2bow(spark: SparkSession, sf: str) -> DataFrame:
    """All documents against the dictionary of the English ones: unknown terms fall out."""
    docs = token_table(spark, sf, "lang")
    return D.doc2bow(docs, D.build_dictionary(docs.filter("lang = 'en'")))


@query(f"""WITH bow AS ({BOW_SQL})
SELECT doc_id, array_to_string(list(term_id ORDER BY term_id), ' ') AS term_ids FROM bow GROUP BY doc_id""")
def bow_to_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return D.bow_to_tokens(doc2bow(spark, sf)).select("doc_id", F.array_join("term_ids", " ").alias("term_ids"))


@query(f"""WITH {WORDS_CTE} SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df
FROM words GROUP BY term""")
def count_vectorize(spark: SparkSession, sf: str) -> DataFrame:
    """Document-term matrix of all documents, read back as column sums."""
    docs = token_table(spark, sf)
    dictionary = materialize(D.build_dictionary(docs), "dictionary")
    sums = D.column_sums(D.count_vectorize(docs, dictionary))
    return D.ids_to_terms(sums, dictionary.select("term_id", "term")).select(
        "term", F.round("total").cast("bigint").alias("cf"), F.col("nonzero").alias("df")
    )


@query(f"""WITH {WORDS_CTE},
old AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM words WHERE lang = 'en' GROUP BY term),
every AS (SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM words GROUP BY term)
SELECT term, cf, df, coalesce(term_id, (SELECT count(*) FROM old) - 1 + row_number() OVER (PARTITION BY term_id IS NULL ORDER BY term)) AS term_id
FROM every LEFT JOIN old USING (term)""")
def add_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary of the English documents grows by those in other languages."""
    docs = token_table(spark, sf, "lang")
    first = materialize(D.build_dictionary(docs.filter("lang = 'en'")), "dictionary")
    return D.add_documents(first, docs.filter("lang <> 'en'"))


@query(f"""WITH {WORDS_CTE}, c AS (SELECT term, count(*) AS n FROM words GROUP BY term),
ids AS (SELECT term, n, row_number() OVER (ORDER BY term) - 1 AS term_id FROM c)
SELECT term_id, term, CAST(n AS BIGINT) AS cf FROM ids""")
def ids_to_terms(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = materialize(D.build_dictionary(documents(spark, sf)), "dictionary")
    return D.ids_to_terms(dictionary.select("term_id", "cf"), dictionary).select("term_id", "term", "cf")


PAIRS_CTE = f"""{WORDS_CTE}, pos AS (SELECT doc_id, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS term FROM tok),
adj AS (SELECT doc_id, i, term AS a, lead(term) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM pos),
pairs AS (SELECT a, b, count(*) AS n_ab FROM adj WHERE b IS NOT NULL GROUP BY a, b),
uni AS (SELECT term, count(*) AS n FROM words GROUP BY term),
phrases AS (SELECT a, b, n_ab, x.n AS n_a, y.n AS n_b,
    CAST((n_ab - 5) * (SELECT count(*) FROM uni) AS DOUBLE) / (x.n * y.n) AS score
  FROM pairs JOIN uni x ON a = x.term JOIN uni y ON b = y.term
  WHERE n_ab >= 5 AND CAST((n_ab - 5) * (SELECT count(*) FROM uni) AS DOUBLE) / (x.n * y.n) > 10)"""


@query(f"WITH {PAIRS_CTE} SELECT a, b, n_ab, n_a, n_b, round(score, 6) AS score FROM phrases")
def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(PH.score_phrases(token_table(spark, sf)))


@query(f"""WITH {PAIRS_CTE},
marked AS (SELECT doc_id, i, adj.a, adj.b, phrases.a IS NOT NULL AS hit FROM adj LEFT JOIN phrases USING (a, b)),
runs AS (SELECT *, i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY doc_id ORDER BY i), 0) AS in_run FROM marked),
taken AS (SELECT *, hit AND in_run % 2 = 1 AS take FROM runs),
kept AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY doc_id ORDER BY i), false) AS eaten FROM taken)
SELECT doc_id, string_agg(CASE WHEN take THEN a || '_' || b ELSE a END, ' ' ORDER BY i) AS merged
FROM kept WHERE NOT eaten GROUP BY doc_id""")
def merge_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    docs = token_table(spark, sf)
    phrases = materialize(PH.score_phrases(docs), "phrases")
    merged = PH.merge_phrases(docs, phrases)
    return C.drop_empty(merged).select("doc_id", TX.join_tokens(F.col("tokens")).alias("merged"))


@query(f"""WITH {WORDS_CTE} SELECT term, count(*) AS cf FROM words WHERE term NOT IN ({sql_list(TX.STOPWORDS)}) GROUP BY term""")
def word_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return D.word_frequencies(documents(spark, sf), TX.STOPWORDS)


@query(f"""WITH {BATCH_CTE} SELECT doc_id, rank FROM batches""")
def shuffled_rank(spark: SparkSession, sf: str) -> DataFrame:
    return RK.shuffled_rank(table(spark, sf, "documents", "doc_id"), "doc_id", SEED)


@query(f"""WITH {BATCH_CTE} SELECT doc_id, split FROM batches""")
def split_train_eval(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_train_eval(table(spark, sf, "documents", "doc_id"), "doc_id", SEED)


@query(f"""WITH {BATCH_CTE} SELECT doc_id, split, batch_id, pos FROM batches""")
def assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    return S.assign_batches(table(spark, sf, "documents", "doc_id"), "doc_id", SEED)


@query(f"""WITH {BATCH_CTE}, joined AS (SELECT split, batch_id, count(*) AS n_docs,
    array_to_string(flatten(list(tokens ORDER BY pos)), ' ') AS joined FROM batches GROUP BY split, batch_id)
SELECT split, batch_id, n_docs, sha256(joined) AS text_sha256, md5(joined) AS text_md5 FROM joined""")
def batch_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    batches = S.assign_batches(documents(spark, sf), "doc_id", SEED)
    return D.batch_fingerprint(batches, ["split", "batch_id"], "pos").drop("text")


@query(f"""WITH {BATCH_CTE}, grouped AS (SELECT split, batch_id, flatten(list(tokens ORDER BY pos)) AS t FROM batches GROUP BY ALL)
SELECT split, batch_id, md5(array_to_string(t, ' ')) AS blank_md5, md5(array_to_string(t, '')) AS glued_md5,
  CAST(len(t) AS INTEGER) AS n_tokens FROM grouped""")
def join_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a batch joined with a blank and without a separator."""
    batches = S.assign_batches(documents(spark, sf), "doc_id", SEED)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "tokens")))
    grouped = batches.groupBy("split", "batch_id").agg(F.transform(ordered, lambda r: r["tokens"]).alias("docs"))
    return grouped.select(
        "split",
        "batch_id",
        F.md5(TX.join_documents(F.col("docs"))).alias("blank_md5"),
        F.md5(TX.glue_documents(F.col("docs"))).alias("glued_md5"),
        F.size(F.flatten("docs")).alias("n_tokens"),
    )


@query(f"""WITH {BATCH_CTE}, n AS (SELECT split, batch_id, count(*) AS n_docs FROM batches GROUP BY split, batch_id)
SELECT split, batch_id, n_docs, CAST(n_docs // 5 AS BIGINT) AS chunksize FROM n""")
def chunk_sizes(spark: SparkSession, sf: str) -> DataFrame:
    batches = S.assign_batches(table(spark, sf, "documents", "doc_id"), "doc_id", SEED)
    n = batches.groupBy("split", "batch_id").agg(F.count("*").alias("n_docs"))
    return n.withColumn("chunksize", P.chunk_size(F.col("n_docs")))


GRID_VALUES = {"topics": [20, 45, 70], "alpha_str": ["symmetric", "0.31"], "beta_str": ["symmetric", "0.61"]}
GRID_SQL = """(SELECT * FROM (VALUES (20), (45), (70)) t(topics), (VALUES ('symmetric'), ('0.31')) a(alpha_str),
  (VALUES ('symmetric'), ('0.61')) b(beta_str), (VALUES ('eval'), ('train')) c(type))"""
GRID_AXES = ["topics", "alpha_str", "beta_str", "type"]


@query(f"""WITH {BATCH_CTE}, one AS (SELECT split, batch_id, count(*) AS n_docs FROM batches GROUP BY split, batch_id)
SELECT split, batch_id, n_docs, topics, alpha_str, beta_str, type FROM one CROSS JOIN {GRID_SQL}""")
def grid_x_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination with every train and eval batch; a combination's own type does not filter."""
    batches = S.assign_batches(table(spark, sf, "documents", "doc_id"), "doc_id", SEED)
    sizes = batches.groupBy("split", "batch_id").agg(F.count("*").alias("n_docs"))
    return GR.with_grid(sizes, GR.product(spark, {**GRID_VALUES, "type": P.TYPES}), GRID_AXES)


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'),
    lambda x: regexp_full_match(x, '[a-z]{2,}')) AS tokens FROM conversations),
places AS (SELECT conv_id, turn, tokens, unnest(generate_series(1, len(tokens))) AS n FROM t)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n_words, array_to_string(tokens[1:n], ' ') AS prefix FROM places""")
def prefix_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "conversations").select("conv_id", "turn", TX.tokenize(F.col("text")).alias("tokens"))
    return C.prefix_rows(docs)


# Vectors by word: dictionary ids go round the table of embeddings, of each round the last UNKNOWN words have none.
UNKNOWN = 50
EMBED_CTE = f"""{WORDS_CTE}, d AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM words GROUP BY term),
size AS (SELECT count(*) + {UNKNOWN} AS n FROM embeddings),
pos AS (SELECT doc_id, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS token FROM tok),
e AS (SELECT vec_id, embedding FROM embeddings),
placed AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, embedding IS NOT NULL AS found,
  coalesce(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 0) AS checksum
  FROM pos JOIN d ON d.term = pos.token CROSS JOIN size LEFT JOIN e ON vec_id = term_id % n)"""


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    docs = token_table(spark, sf)
    embeddings = table(spark, sf, "embeddings", "vec_id", "embedding")
    dictionary = D.build_dictionary(docs).withColumn("vec_id", F.col("term_id") % (embeddings.count() + UNKNOWN))
    vectors = dictionary.join(embeddings, "vec_id").select(F.col("term").alias("token"), F.col("embedding").alias("vector"))
    return D.embed_tokens(docs, materialize(vectors, "vectors"), 64)


@F.arrow_udf(DoubleType())
def column_checksum(vectors: pa.Array) -> pa.Array:
    """The same over a whole column, added up in the same order."""
    flat, sizes = vectors.flatten(), vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    sums = np.bincount(owner, flat.fill_null(0).to_numpy(zero_copy_only=False) * place, len(sizes))
    unknown = ~vectors.is_valid().to_numpy(zero_copy_only=False)
    unknown[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return pa.array(sums, mask=unknown)


def checksum(vector):
    """Every element of a vector counts, by its place."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


@query(f"WITH {EMBED_CTE} SELECT doc_id, pos, token, found, round(checksum, 4) AS checksum FROM placed")
def embed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The whole vector of each token, as a checksum; unknown words get zeros."""
    return embedded(spark, sf).select("doc_id", "pos", "token", "found", F.round(column_checksum("vector"), 4).alias("checksum"))


@query(f"""WITH {EMBED_CTE} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_vectors, round(sum(checksum * (pos + 1)), 2) AS checksum
FROM placed GROUP BY doc_id""")
def stack_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of each document in token order, as a checksum over places and elements."""
    stacked = D.stack_vectors(embedded(spark, sf), together=True)
    by_place = F.transform("vectors", lambda v, i: checksum(v) * (i + 1))
    total = F.aggregate(by_place, F.lit(0.0), lambda a, x: a + x)
    return stacked.select("doc_id", F.size("vectors").alias("n_vectors"), F.round(total, 2).alias("checksum"))


# Topic stand-in: the languages, with the words' counts as topic weights.
WEIGHTS_CTE = f"""{WORDS_CTE}, weights AS (SELECT lang AS topic, term, CAST(count(*) AS DOUBLE) AS weight FROM words GROUP BY lang, term),
phi AS (SELECT topic, term, weight / sum(weight) OVER (PARTITION BY topic) AS phi FROM weights),
shares AS (SELECT lang AS topic, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM words GROUP BY lang),
joint AS (SELECT topic, term, phi, share, phi * share AS joint, sum(phi * share) OVER (PARTITION BY term) AS p_w
  FROM phi JOIN shares USING (topic))"""


def language_weights(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    counts = D.term_counts(documents(spark, sf, "lang") if docs is None else docs, ["lang"])
    return materialize(counts.select(F.col("lang").alias("topic"), "term", F.col("cf").cast("double").alias("weight")), "weights")


def language_shares(weights: DataFrame) -> DataFrame:
    return G.topic_shares(weights.select("topic", F.lit(1.0).alias("theta"), F.col("weight").alias("n_tokens")))


@query(f"""WITH {WEIGHTS_CTE}, r AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS place FROM weights)
SELECT topic, CAST(place AS INTEGER) AS place, term, weight FROM r WHERE place <= 20""")
def top_words_per_topic(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_words(language_weights(spark, sf), 20)


@query(f"WITH {WEIGHTS_CTE} SELECT topic, term, round(phi, 9) AS phi FROM phi")
def topic_word_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.topic_word_matrix(language_weights(spark, sf)), 9)


@query(f"WITH {WEIGHTS_CTE} SELECT topic, round(share, 9) AS share FROM shares")
def topic_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(language_shares(language_weights(spark, sf)), 9)


@query(f"""WITH {WEIGHTS_CTE} SELECT term, round(max(p_w) * sum(joint / p_w * ln(joint / p_w / share)), 9) AS saliency FROM joint GROUP BY term""")
def word_saliency(spark: SparkSession, sf: str) -> DataFrame:
    w = language_weights(spark, sf)
    return rounded(G.saliency(G.topic_word_matrix(w), language_shares(w)), 9)


@query(f"""WITH {WEIGHTS_CTE}, s AS (SELECT topic, term, round(0.6 * ln(phi) + 0.4 * ln(phi / p_w), 9) AS relevance FROM joint),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, term) AS place FROM s)
SELECT topic, term, relevance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 30""")
def word_relevance(spark: SparkSession, sf: str) -> DataFrame:
    w = language_weights(spark, sf)
    return rounded(G.relevance(G.topic_word_matrix(w), language_shares(w)), 9)


@query(f"""WITH {WEIGHTS_CTE}, s AS (SELECT term, topic, round(joint / p_w, 9) AS p FROM joint WHERE joint / p_w >= 0.01)
SELECT term, topic, p, CAST(row_number() OVER (PARTITION BY term ORDER BY p DESC, topic) AS INTEGER) AS place FROM s""")
def per_word_topics(spark: SparkSession, sf: str) -> DataFrame:
    w = language_weights(spark, sf)
    return rounded(G.per_word_topics(G.topic_word_matrix(w), language_shares(w)), 9)


@query(f"""WITH {WEIGHTS_CTE}, r AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS place FROM weights),
top AS (SELECT topic, term, place FROM r WHERE place <= 20),
seen AS (SELECT DISTINCT doc_id, topic, term FROM words JOIN top USING (term)),
d AS (SELECT topic, term, count(*) AS n FROM seen GROUP BY topic, term),
dd AS (SELECT x.topic, x.term AS a, y.term AS b, count(*) AS n FROM seen x JOIN seen y ON x.doc_id = y.doc_id AND x.topic = y.topic AND x.term <> y.term GROUP BY ALL),
docs AS (SELECT count(*) AS n FROM documents),
s AS (SELECT l.topic, avg(ln((coalesce(dd.n, 0) / docs.n + 1e-12) / (d.n / docs.n))) AS u_mass
  FROM top l JOIN top e ON l.topic = e.topic AND l.place > e.place JOIN d ON d.topic = e.topic AND d.term = e.term
  LEFT JOIN dd ON dd.topic = l.topic AND dd.a = l.term AND dd.b = e.term CROSS JOIN docs GROUP BY l.topic)
SELECT topic, round(u_mass, 9) AS u_mass, CAST(row_number() OVER (ORDER BY u_mass DESC, topic) AS INTEGER) AS place FROM s""")
def rank_topics_umass(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as topics, twenty words each."""
    docs = token_table(spark, sf, "lang")
    top = G.top_words(language_weights(spark, sf, docs), 20).withColumnRenamed("place", "place_in_topic")
    return rounded(CO.coherence_umass(docs, materialize(top, "topics")), 9)


CV_TOP = f"""{WEIGHTS_CTE}, r AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS place FROM weights),
top AS (SELECT topic, term FROM r WHERE place BETWEEN 31 AND 50),
pos AS (SELECT doc_id, len(tokens) AS size, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS term FROM tok),
hits AS (SELECT doc_id, size, pos, topic, term FROM pos JOIN top USING (term)),
win AS (SELECT DISTINCT doc_id, topic, term, unnest(generate_series(greatest(0, pos - 109), least(pos, greatest(size - 110, 0)))) AS w FROM hits),
counts AS (SELECT x.topic, x.term AS a, y.term AS b, count(*) AS n FROM win x
  JOIN win y ON x.doc_id = y.doc_id AND x.topic = y.topic AND x.w = y.w AND x.term <= y.term GROUP BY ALL)"""


def mid_words(spark: SparkSession, sf: str, docs: DataFrame) -> DataFrame:
    """Languages as topics, words 31 to 50 by weight."""
    return materialize(G.top_words(language_weights(spark, sf, docs), 50).filter("place > 30").select("topic", "term"), "topics")


@query(f"WITH {CV_TOP} SELECT topic, a, b, n FROM counts")
def coherence_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = token_table(spark, sf, "lang")
    return CO.window_counts(docs, mid_words(spark, sf, docs))


@query(f"""WITH {CV_TOP}, total AS (SELECT sum(greatest(1, len(tokens) - 109)) AS n FROM tok WHERE len(tokens) > 0),
full_counts AS (SELECT topic, a, b, n FROM counts UNION ALL SELECT topic, b, a, n FROM counts WHERE a <> b),
grid AS (SELECT x.topic, x.term AS a, y.term AS b FROM top x JOIN top y USING (topic)),
p AS (SELECT g.topic, g.a, g.b, coalesce(f.n, 0) / total.n + 1e-12 AS j, (sa.n / total.n) * (sb.n / total.n) AS free
  FROM grid g LEFT JOIN full_counts f USING (topic, a, b) JOIN counts sa ON sa.topic = g.topic AND sa.a = g.a AND sa.b = g.a
  JOIN counts sb ON sb.topic = g.topic AND sb.a = g.b AND sb.b = g.b CROSS JOIN total),
x AS (SELECT topic, a, b, ln(j / free) / -ln(j) AS x FROM p),
s AS (SELECT topic, b, sum(x) AS s FROM x GROUP BY topic, b),
c AS (SELECT topic, a, sum(x * s) / (sqrt(sum(x * x)) * sqrt(sum(s * s))) AS cosine FROM x JOIN s USING (topic, b) GROUP BY topic, a)
SELECT topic, round(avg(cosine), 6) AS c_v FROM c GROUP BY topic""")
def coherence_cv(spark: SparkSession, sf: str) -> DataFrame:
    docs = token_table(spark, sf, "lang")
    return rounded(CO.coherence_cv(docs, mid_words(spark, sf, docs)))


PROBS_CTE = f"""ranked AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS ofs FROM embeddings),
e AS (SELECT vec_id, CAST(ofs // 50 AS BIGINT) AS batch_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS e FROM ranked),
probs AS (SELECT vec_id, batch_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""


def vector_distributions(spark: SparkSession, sf: str) -> DataFrame:
    """batch_id, vec_id, distribution: softmax of the embeddings, in batches of 50, written once."""
    ranked = RK.shuffled_rank(table(spark, sf, "embeddings", "vec_id", "embedding"), "vec_id", SEED)
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    shares = ranked.withColumn("e", F.transform("embedding", lambda x: F.exp(x.cast("double")))).withColumn("s", total)
    rows = shares.select(
        F.floor((F.col("rank") - 1) / 50).alias("batch_id"), "vec_id", F.transform("e", lambda x: x / F.col("s")).alias("distribution")
    )
    return materialize(rows, "distributions")


@query(f"""WITH {PROBS_CTE}, d AS (SELECT batch_id, vec_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM probs)
SELECT a.batch_id, a.vec_id AS vec_id_1, b.vec_id AS vec_id_2,
  round(sum(a.p * ln(2 * a.p / (a.p + b.p)) + b.p * ln(2 * b.p / (a.p + b.p))) / 2, 9) AS js
FROM d a JOIN d b ON a.batch_id = b.batch_id AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY ALL""")
def js_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.js_distance(vector_distributions(spark, sf), ["batch_id"], "vec_id"), 9)


@query(f"""WITH {PROBS_CTE} SELECT vec_id, 'Topic ' || CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) AS label,
  CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS topic FROM probs""")
def strongest_topic(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_distributions(spark, sf)
    d = F.col("distribution")
    return rows.select("vec_id", X.topic_label(d).alias("label"), X.strongest_topic(d).alias("topic"))


@query()
def pcoa_2d(spark: SparkSession, sf: str) -> DataFrame:
    return G.pcoa_2d(vector_distributions(spark, sf), ["batch_id"], "vec_id")


@query("""WITH t AS (SELECT doc_id, '0.1*"' || lang || '" + 0.2*"' || source || '" + 0.05*"n' || CAST(n_chars AS VARCHAR) || '"' AS topic FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(topic, '"(.*?)"', 1), ' ') AS words FROM t""")
def words_from_topic_string(spark: SparkSession, sf: str) -> DataFrame:
    topic = F.format_string('0.1*"%s" + 0.2*"%s" + 0.05*"n%s"', "lang", "source", "n_chars")
    docs = table(spark, sf, "documents").select("doc_id", topic.alias("topic"))
    return docs.select("doc_id", F.array_join(TX.words_in_double_quotes(F.col("topic")), " ").alias("words"))


TOPWORDS_CTE = TOK_CTE + """, few AS (SELECT doc_id, lang, tokens AS t FROM tok),
printed AS (SELECT doc_id, '[[''' || coalesce(array_to_string(t, ''', '''), '') || '''], [''' || lang || '_' || lang || ''']]' AS top_words FROM few)"""


def printed_topwords(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, top_words: the tokens of each document and a two-part word, printed as a list of lists."""
    docs = documents(spark, sf, "lang")
    lists = F.array("tokens", F.array(F.concat_ws("_", "lang", "lang")))
    return docs.select("doc_id", TX.printed_word_lists(lists).alias("top_words"))


@query(rf"""WITH {TOPWORDS_CTE} SELECT doc_id,
  array_to_string(regexp_extract_all(top_words, '''([A-Za-z]+_?[A-Za-z])''', 1), ' ') AS literal_words,
  array_to_string(regexp_extract_all(top_words, '''([A-Za-z]+(?:_[A-Za-z]+)*)''', 1), ' ') AS words FROM printed""")
def words_from_topwords(spark: SparkSession, sf: str) -> DataFrame:
    rows = printed_topwords(spark, sf)
    w = F.col("top_words")
    return rows.select("doc_id", TX.words_in_single_quotes(w, literal=True).alias("literal_words"), TX.words_in_single_quotes(w).alias("words"))


@query("""SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS letters FROM documents""")
def keep_letters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", TX.keep_letters(F.col("text")).alias("letters"))


@query(f"""WITH {WORDS_CTE}, d AS (SELECT doc_id, CAST(count(*) AS DOUBLE) / count(DISTINCT term) AS score FROM words GROUP BY doc_id)
SELECT round(median(score), 6) AS median_score FROM d""")
def median_doc_score(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per distinct token stands for the score of a document."""
    docs = C.drop_empty(documents(spark, sf))
    scored = docs.select((F.size("tokens") / F.size(F.array_distinct("tokens"))).alias("score"))
    return rounded(RK.median(scored, [], "score", "median_score"))


@query(f"""WITH {TOK_CTE} SELECT doc_id, CAST(sum(len(tokens)) OVER (ORDER BY doc_id) AS BIGINT) AS cumulative_count FROM tok""")
def cumulative_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of all documents up to each one."""
    sizes = documents(spark, sf).select("doc_id", F.size("tokens").cast("bigint").alias("n"))
    return RK.running_total(sizes, [F.col("doc_id")], weight="n", name="cumulative_count").drop("n")
