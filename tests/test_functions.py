"""Column functions and helpers on small fixtures."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from topicloom.functions import priors as P
from topicloom.functions import scalars as X
from topicloom.functions import text as TX
from topicloom.operators import variational as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_quoted_words(spark):
    printed = "[['health', 'public_health'], ['a', 'covid_19']]"
    assert one(spark, TX.words_in_single_quotes(F.col("w"), literal=True), w=printed) == "health"
    assert one(spark, TX.words_in_single_quotes(F.col("w")), w=printed) == "health public_health a"
    assert one(spark, TX.words_in_double_quotes(F.col("w")), w='0.1*"health" + 0.2*"data"') == ["health", "data"]


def test_tokens_are_whole_ascii_runs(spark):
    assert one(spark, TX.tokenize(F.col("t")), t="The été x1 ab_c Cats, I'm été2 dogs") == ["the", "cats", "dogs"]


def test_html(spark):
    html = "<html><script>var t='</p>';</script><!-- x --><p>a &amp;lt; b</p>\n<b>c</b></html>"
    assert one(spark, TX.html_to_text(F.col("h")), h=html) == "a &lt; b c"


def test_repair_scores(spark):
    values = ["0.5", "nan", "inf", "-inf", "", None, "failed"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.s for r in rows.select("i", X.repaired_score(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == [0.5, 0, 0, 0, 0, 0, 0]


def test_priors(spark):
    rows = spark.createDataFrame([("symmetric",), ("asymmetric",), ("0.31",), ("wrong",)], "v string")
    got = rows.select("v", P.numeric_alpha(F.col("v")).cast("double").alias("a"), P.numeric_beta(F.col("v")).cast("double").alias("b"), P.prior_is_valid(F.col("v")).alias("ok")).collect()
    by = {r.v: r for r in got}
    assert math.isclose(by["symmetric"].a, 1 / 21, abs_tol=1e-15)
    assert math.isclose(by["asymmetric"].a, 1 / (21 + math.sqrt(21)), abs_tol=1e-15)
    assert by["0.31"].a == 0.31 and by["wrong"].a is None
    assert by["asymmetric"].b is None and not by["wrong"].ok and by["asymmetric"].ok
    assert math.isclose(sum(P.vector_prior(7)), 1)
    assert len(P.TOPIC_COUNTS) * len(P.ALPHA_LABELS) * len(P.BETA_LABELS) * 2 == 1260


def test_time_key_and_years(spark):
    import hashlib

    ts = datetime.datetime(2024, 9, 28, 1, 2, 3, 45)
    assert one(spark, X.time_key(F.col("t")), t=ts) == hashlib.md5(b"20240928010203000045").hexdigest()
    assert one(spark, X.year_or_sentinel(F.col("d")), d="2016-05") == 2016
    assert one(spark, X.year_or_sentinel(F.col("d")), d="no date") == 9999
    assert one(spark, X.percent_to_number(F.col("d")), d="87%") == 87.0


def test_strongest_topic_takes_the_first_on_a_tie(spark):
    assert one(spark, X.topic_label(F.col("p")), p=[0.2, 0.4, 0.4]) == "Topic 1"


def test_js_divergence(spark):
    assert math.isclose(one(spark, X.js_divergence(F.col("p"), F.col("q")), p=[1.0, 0.0], q=[0.0, 1.0]), math.log(2))
    assert one(spark, X.js_divergence(F.col("p"), F.col("q")), p=[0.3, 0.7], q=[0.3, 0.7]) == 0


def test_digamma_and_log_gamma():
    assert math.isclose(V.digamma(np.array([1.0]))[0], -0.5772156649015329, abs_tol=1e-9)
    assert math.isclose(V.digamma(np.array([0.5]))[0], -1.9635100260214235, abs_tol=1e-9)
    for x in (0.01, 0.5, 1.0, 3.7, 40.0):
        assert math.isclose(V.log_gamma(np.array([x]))[0], math.lgamma(x), rel_tol=1e-9, abs_tol=1e-9)


def test_window_pairs_against_formed_windows():
    rng = np.random.RandomState(1)
    slots = rng.randint(-1, 4, 400)
    bounds = [0, 3, 3, 300, 400]
    pairs, total = V.window_pairs(slots, bounds, 4, window=20, block=37)
    want, n = np.zeros((4, 4)), 0
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            continue
        for s in range(max(1, b - a - 19)):
            here = {w for w in slots[a + s : min(b, a + s + 20)] if w >= 0}
            n += 1
            for x in here:
                for y in here:
                    want[x, y] += 1
    assert total == n and (pairs == want).all()
