"""One query for each operator over its whole table, and the SQL checks of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated_words
from .fuzzy_lines import fuzzy_lines
from .hilbert_packing import pack
from .html_consensus import main_text
from .jaccard_join import jaccard_classes
from .line_quality import (
    BOILERPLATE,
    BOILERPLATE_CHARS,
    ENDS,
    LOST_PERCENT,
    MENU_SEPARATORS,
    MENU_WORDS,
    MIN_WORDS,
    NO_ENDS,
    PLAIN_WORDS,
    REPEAT_PERCENT,
    SEPARATORS,
    SYMBOLS,
    line_quality,
)
from .mil_quality import score, train
from .periodic_runs import periodic_runs
from .pii_boosting import KINDS, personal_data
from .seed_extend import remove_repeats
from .spelling_variants import spelling_variants
from .url_filter import BIN, HELD_OUT, MIN_CONTEXT, ORDER, UNIT, url_filter
from .warc_derivatives import derivatives, responses_of_pages

Query = Callable[[SparkSession, str], DataFrame]

WARC_DATE = "2024-01-01T00:00:00Z"  # the page table has no fetch times

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {ALNUM_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, {ALNUM_WORDS}) AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hits AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, words)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items i USING (doc_id)"""


@query(DECONTAMINATION_SQL)
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = contaminated_words(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {BLANK_WORDS}), []) AS w FROM documents),
places AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS words
  FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
again AS (SELECT words FROM places GROUP BY words HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM places JOIN again USING (words), unnest(range(i, i + 35)) AS t(p)),
every AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n
  FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query(REPEATS_SQL)
def op7_seed_extend(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {BLANK_WORDS}), []) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM d),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets"""


@query(JACCARD_SQL)
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_classes(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def _sql_chars(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


LINE_FAILS_SQL = f"""({_sql_chars("x", SYMBOLS)} * 10 > length(x)
  OR ({_sql_chars("x", " ")} + 1 >= {PLAIN_WORDS} AND NOT regexp_matches(x, '{ENDS}') AND NOT regexp_matches(x, '{NO_ENDS}'))
  OR ({_sql_chars("x", SEPARATORS)} >= 3 AND {_sql_chars("x", SEPARATORS)} * 5 >= {_sql_chars("x", " ")} + 1)
  OR (regexp_matches(x, '(?i){MENU_WORDS}') AND regexp_replace(x, '(?i){MENU_WORDS}|{MENU_SEPARATORS}', '', 'g') = '')
  OR (length(x) >= 20 AND regexp_matches(x, '\\p{{Lu}}\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}')
    AND len(regexp_extract_all(x, '\\p{{Lu}}')) * 2 > len(regexp_extract_all(x, '\\p{{L}}')))
  OR ({_sql_chars("x", "!")} >= 3 AND {_sql_chars("x", "!")} * 4 > {_sql_chars("x", " ")} + 1)
  OR (length(x) < {BOILERPLATE_CHARS} AND regexp_matches(x, '(?i){BOILERPLATE}')))"""

QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, {BLANK_WORDS}), []) AS w,
  string_split(coalesce(text, ''), chr(10)) AS every FROM documents),
l AS (SELECT *, list_filter(every, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM d, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM windows JOIN twice USING (doc_id, g), unnest(range(i, i + 3)) AS t(p) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, {_sql_chars("text", SYMBOLS)} AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    list_sum(list_transform(list_filter(lines, lambda x: {LINE_FAILS_SQL}), lambda x: length(x))) AS lost,
    length(replace(text, chr(10), '')) AS total
  FROM l LEFT JOIN repeated USING (doc_id)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines,
  n_repeat_words, base_failed, NOT base_failed AND coalesce(lost, 0) * 100 <= total * {LOST_PERCENT} AS kept FROM g"""


@query(QUALITY_SQL)
def op2_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return line_quality(table(spark, sf, "documents")).select("doc_id", *[f"quality.{x}" for x in fields])


@query()
def op3_hilbert_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query()
def op6_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    records = derivatives(responses_of_pages(table(spark, sf, "pages"), WARC_DATE))
    return records.withColumn("page_id", F.col("source_id").cast("long")).drop("source_id")


@query()
def op9_mil_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs, table(spark, sf, "labels").filter(fold != 1), "doc_id", "text", "quality")
    return score(docs, model).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op10_html_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op4_fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy_lines(table(spark, sf, "documents").select("doc_id", "text"), short_lines=True).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op5_pii_boosting(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data(table(spark, sf, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count_of(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


# The production rules: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _rule_sql(field: int) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, h + p)[field]}'" for v, h, p in ordered]
    return f"CASE {' '.join(cases)} END"


def _model_sql(order: int) -> str:
    steps = ["""totals AS (SELECT count(DISTINCT right(gram, 1)) AS n, sum(yes) AS yes, sum(no) AS no FROM grams),
m0 AS (SELECT right(gram, 1) AS s, (sum(g.yes) + CAST(1 AS DOUBLE)) / (any_value(t.yes) + any_value(t.n)) AS p_yes,
  (sum(g.no) + CAST(1 AS DOUBLE)) / (any_value(t.no) + any_value(t.n)) AS p_no FROM grams g, totals t GROUP BY 1)"""]
    for k in range(1, order + 1):
        mixed = ", ".join(
            f"CASE WHEN n_{x} >= {MIN_CONTEXT} THEN (c.{x} + kinds_{x} * m.p_{x}) / (n_{x} + kinds_{x}) ELSE m.p_{x} END AS p_{x}" for x in ("yes", "no")
        )
        steps.append(f"""c{k} AS (SELECT right(gram, {k + 1}) AS s, sum(yes) AS yes, sum(no) AS no FROM grams GROUP BY 1),
x{k} AS (SELECT left(s, {k}) AS context, sum(yes) AS n_yes, sum(no) AS n_no, count(*) FILTER (yes > 0) AS kinds_yes,
  count(*) FILTER (no > 0) AS kinds_no FROM c{k} GROUP BY 1),
m{k} AS (SELECT c.s, {mixed} FROM c{k} c JOIN x{k} ON context = left(c.s, {k}) JOIN m{k - 1} m ON m.s = right(c.s, {k}))""")
    return ",\n".join(steps)


URL_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS label, left(md5(url), 1) IN ({", ".join(repr(x) for x in HELD_OUT)}) AS held FROM p),
places AS (SELECT page_id, label, held, substring(repeat(chr(2), {ORDER}) || url || chr(3), i, {ORDER + 1}) AS gram
  FROM r, unnest(range(1, length(url) + 2)) AS t(i)),
grams AS (SELECT gram, CAST(count(*) FILTER (label = 'allow' AND NOT held) AS DOUBLE) AS yes,
  CAST(count(*) FILTER (label = 'block' AND NOT held) AS DOUBLE) AS no FROM places GROUP BY 1),
{_model_sql(ORDER)},
ratios AS (SELECT s AS gram, CAST(round((ln(p_yes) - ln(p_no)) * {UNIT}) AS BIGINT) AS ratio FROM m{ORDER}),
bins AS (SELECT page_id, floor(CAST(sum(ratio) AS DOUBLE) / (count(*) * {BIN})) AS bin FROM places JOIN ratios USING (gram) GROUP BY 1),
held AS (SELECT bin, count(*) FILTER (label = 'allow') AS yes, count(*) FILTER (label = 'block') AS no
  FROM r JOIN bins USING (page_id) WHERE held AND label IS NOT NULL GROUP BY 1),
curve AS (SELECT bin, sum(yes) OVER () AS all_yes, sum(no) OVER () AS all_no, sum(yes) OVER (ORDER BY bin DESC) AS kept,
  sum(no) OVER (ORDER BY bin) - no AS refused, lag(bin) OVER (ORDER BY bin) AS before FROM held),
least AS (SELECT coalesce((SELECT CASE WHEN before IS NULL THEN bin ELSE floor((before + bin + 1) / 2) END FROM curve WHERE all_yes > 0 AND all_no > 0 ORDER BY kept * all_no + refused * all_yes DESC, bin LIMIT 1), 0) AS bin)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN b.bin >= least.bin THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN bins b USING (page_id), least"""


@query(URL_SQL)
def op11_url_language_model(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_filter(table(spark, sf, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", *[f"judged.{x}" for x in ("host", "path", "rule", "verdict")])


CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def _crc_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of `text`, by the table `crc`."""
    code = f"hex(encode({text}))"
    values = f"list_transform(range(CAST(length({code}) // 2 AS BIGINT)), lambda i: CAST('0x' || substring({code}, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {values}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


# A run of four periods and six words or more has equal five-word phrases one period apart; neighbours of one distance make up a run.
RUNS_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {BLANK_WORDS}), []) AS v, {_crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
e AS (SELECT *, len(v) AS n, (h // 10) % greatest(len(v), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
g AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: v[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE v END AS w FROM f),
phrases AS (SELECT doc_id, n, i, md5(array_to_string(w[i + 1:i + 5], ' ')) AS x FROM g, unnest(range(n - 4)) AS t(i) WHERE n >= 5),
same AS (SELECT a.doc_id, b.i - a.i AS period, a.i AS i FROM phrases a JOIN phrases b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, period, min(i) AS start, count(*) + 4 + period AS length FROM islands GROUP BY doc_id, period, island),
runs AS (SELECT doc_id, start, length, CAST(min(period) AS BIGINT) AS period FROM stretches WHERE length >= greatest(6, 4 * period) GROUP BY ALL),
of_doc AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
  min((-length, start, period)) AS best FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS words FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM g) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, -1000 * best[1] // best[3] AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM g LEFT JOIN of_doc USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; one document in ten repeats some of its own words to the end, by the contract's rule."""
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+", -1), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("planted"))
    n = F.size("words")
    chosen = chosen.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    p = F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1
    times = F.ceil((n - F.col("a")) / p).cast("int")
    repeated = F.concat(F.slice("words", 1, F.col("a")), F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, p), times)))
    return chosen.select("doc_id", F.when(F.col("planted") & (n > 0), F.array_join(F.slice(repeated, 1, n), " ")).otherwise(F.col("text")).alias("text"))


@query(RUNS_SQL)
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs(_with_planted_runs(table(spark, sf, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["length"]).alias("length"),
        best["period"].alias("period"),
        F.floor(-1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


LETTERS = "[A-Za-z\u00C0-\u00FF]+"
WORD_CHARS, WORD_COUNT = 7, 2  # the shortest and rarest words that count

VARIANTS_SQL = f"""
WITH {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '{LETTERS}')) AS run FROM documents),
long_runs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {WORD_CHARS} GROUP BY ALL),
hashed AS (SELECT run, n, {_crc_sql("concat(CAST(doc_id AS VARCHAR), ':', run)")} AS h FROM long_runs, crc),
tokens AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM tokens WHERE length(word) >= {WORD_CHARS} GROUP BY 1 HAVING sum(n) >= {WORD_COUNT}),
cut AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM words, unnest(range(CAST(length(word) AS INTEGER))) AS t(i)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM words a JOIN cut b ON a.word = b.rest UNION SELECT b.word, a.word FROM words a JOIN cut b ON a.word = b.rest),
best AS (SELECT a AS word, count(*) AS n_near, min((-n, b)) AS best FROM pairs JOIN words ON word = b GROUP BY 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * n THEN best[2] END AS form,
  CASE WHEN -best[1] >= 10 * n THEN -best[1] END AS form_n FROM words LEFT JOIN best USING (word))
SELECT f.word, f.form, coalesce(e.form, d.form, c.form, b.form, f.form, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN forms b ON b.word = f.form LEFT JOIN forms c ON c.word = b.form LEFT JOIN forms d ON d.word = c.form LEFT JOIN forms e ON e.word = d.form"""


def _counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the letter runs of all texts after the contract's deletions, of the length and count asked for."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= WORD_CHARS)  # a shorter run gives no word
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= WORD_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= WORD_COUNT)


@query(VARIANTS_SQL)
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(_counted_words(table(spark, sf, "documents")))
