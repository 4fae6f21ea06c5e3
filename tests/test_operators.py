"""Operators on hand-made fixtures, against brute force, and with hot keys."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import coherence as CO
from topicloom.operators import corpus as C
from topicloom.operators import dictionary as D
from topicloom.operators import geometry as G
from topicloom.operators import grid as GR
from topicloom.operators import phrases as PH
from topicloom.operators import ranking as RK
from topicloom.operators import runs as R
from topicloom.operators import splits as S
from topicloom.operators import stats as ST
from topicloom.operators.skew import spread_join


def values(spark, numbers, group="g"):
    return spark.createDataFrame([(group, float(x)) for x in numbers], "g string, x double")


def test_sample_moments(spark):
    row = ST.moments(values(spark, [1, 2, 2, 9]), ["g"], ["x"]).first()
    assert math.isclose(row.skewness, 1.9001, abs_tol=1e-4) and math.isclose(row.kurtosis, 3.7085, abs_tol=1e-4)
    assert row.n == 4 and row.uss == 90 and math.isclose(row.css, 41)
    flat = ST.moments(values(spark, [3, 3, 3, 3]), ["g"], ["x"]).first()
    assert flat.skewness is None and flat.variance == 0


def test_quantiles_at_jumps_and_between(spark):
    ten = ST.quantiles(values(spark, range(1, 11)), ["g"], ["x"]).first()
    assert (ten.p50, ten.p25, ten.p90, ten.p100, ten.p0) == (5.5, 3, 9.5, 10, 1)
    eleven = ST.quantiles(values(spark, range(1, 12)), ["g"], ["x"]).first()
    assert (eleven.p50, eleven.p25, eleven.p10) == (6, 3, 2)
    assert ST.quantiles(values(spark, [4, 4, 7, 7, 9]), ["g"], ["x"]).first().mode == 4


def test_location_tests(spark):
    row = ST.location_tests(values(spark, [-1, 2, 2, 0, 5]), ["g"], ["x"]).first()
    # ranks of |x| without the zero: 1, 2.5, 2.5, 4; positives sum to 9, minus 4*5/4
    assert row.sign_m == 1 and row.signed_rank_s == 4


def test_crosstab_leaves_out_missing(spark):
    rows = spark.createDataFrame([("s", "a", "x"), ("s", "a", "y"), ("s", "b", "x"), ("s", None, "x")], "g string, r string, c string")
    table = {(t.r, t.c, t.kind): t for t in ST.crosstab(rows, ["g"], "r", "c").collect()}
    assert table[(None, None, "total")].frequency == 3
    cell = table[("a", "x", "cell")]
    assert math.isclose(cell.percent, 100 / 3) and cell.row_pct == 50 and cell.col_pct == 50


def test_running_total_cuts_hot_groups(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = RK.running_total(rows.repartition(5), [F.col("v")], ["g"], name="r").collect()
    for g in ("hot", "cold"):
        mine = sorted((r.v, r.r) for r in got if r.g == g)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))


def test_rank_is_a_reproducible_permutation(spark):
    a = {r.id: r["rank"] for r in RK.shuffled_rank(spark.range(500), "id", 1).collect()}
    b = {r.id: r["rank"] for r in RK.shuffled_rank(spark.range(500).repartition(7), "id", 1).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 501))


def test_split10(spark):
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    rows = S.assign_batches(docs, "doc_id", 3, 0.8, 3).collect()
    sizes = {}
    for r in rows:
        sizes[(r.split, r.batch_id)] = sizes.get((r.split, r.batch_id), 0) + 1
    assert sizes == {("train", 0): 3, ("train", 1): 3, ("train", 2): 2, ("eval", 0): 2}
    labels = {r.doc_id: r.split for r in S.split_train_eval(docs, "doc_id", 3).collect()}
    assert labels == {r.doc_id: r.split for r in rows}
    assert {r.split for r in S.split_train_eval(docs, "doc_id", 3, 0.0).collect()} == {"eval"}
    assert {r.split for r in S.split_train_eval(docs, "doc_id", 3, 1.0).collect()} == {"train"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_with_hot_keys(spark, how):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    rows = rows.withColumn("k", F.when(F.col("k") != 7, F.col("k")))  # 7 becomes null
    lookup = rows.filter("k IS NULL OR k <> 11").groupBy("k").agg(F.count("*").alias("n"))
    salted = spread_join(rows, lookup, ["k"], "n", ["id"], how, hot_rows=1)
    plain = spread_join(rows, lookup, ["k"], "n", ["id"], how)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    expected = 2000 if how == "left" else rows.filter("k IS NULL OR k <> 11").count()
    assert salted.count() == expected


def test_hot_keys_are_cut_by_their_rows(spark):
    """One key with 30 % of the rows and many just above a part are all cut; no part of a key is much larger than asked for."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 3, -1).otherwise(F.col("id") % 90).alias("k"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = spread_join(rows, lookup, ["k"], "n", ["id"], hot_rows=100)
    assert joined.count() == 20_000
    plan = joined._jdf.queryExecution().toString()
    assert "_parts" in plan
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 100))
    largest = joined.groupBy("k", part).agg(F.count("*").alias("m")).agg(F.max("m"), F.count("*")).first()
    assert largest[0] < 180 and largest[1] > 200


def test_remerge_keeps_rows_that_differ(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3)], "g string, x int")
    out = R.group_remerge(rows, ["g"], {"n": F.count("*")}, ["x"])
    assert sorted((r.g, r.x, r.n) for r in out.collect()) == [("a", 1, 1), ("b", 1, 2), ("b", 2, 2), ("c", 1, 3), ("c", 2, 3), ("c", 3, 3)]


def test_schema_violations_and_unwrap(spark):
    rows = spark.createDataFrame([("k1", "0.5", "20"), ("k2", "bad", "x")], "time_key string, coherence string, topics string")
    bad = {(r.time_key, r.column_name, r.value) for r in R.schema_violations(rows, "time_key").collect()}
    assert bad == {("k2", "coherence", "bad"), ("k2", "topics", "x")}
    lists = spark.createDataFrame([(["a"],), (["a", "b"],)], "f array<string>")
    with pytest.raises(Exception, match="multiple elements"):
        R.unwrap_singletons(lists, ["f"]).collect()


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id bigint, tokens array<string>")


def test_dictionary_grows_with_stable_ids(spark):
    first = D.build_dictionary(docs_of(spark, "b a b", "a c"))
    assert {r.term: (r.term_id, r.cf, r.df) for r in first.collect()} == {"a": (0, 2, 2), "b": (1, 2, 1), "c": (2, 1, 1)}
    grown = D.add_documents(first, docs_of(spark, "aa a", "z"))
    assert {r.term: (r.term_id, r.cf, r.df) for r in grown.collect()} == {"a": (0, 3, 3), "b": (1, 2, 1), "c": (2, 1, 1), "aa": (3, 1, 1), "z": (4, 1, 1)}


def test_phrases_merge_left_to_right(spark):
    docs = docs_of(spark, "x x x y", "x y", "")
    phrases = spark.createDataFrame([("x", "x", 2), ("x", "y", 2)], "a string, b string, n_ab bigint")
    out = {r.doc_id: r.tokens for r in PH.merge_phrases(docs, phrases).collect()}
    assert out == {0: ["x_x", "x_y"], 1: ["x_y"], 2: []}


def test_merging_by_brute_force(spark):
    rng = random.Random(9)
    docs = [[rng.choice("xyz") for _ in range(rng.choice([0, 1, 2, 3, 30]))] for _ in range(60)]
    for known in ({"x x"}, {"x y", "y x"}, {"x x", "x y", "y z", "z z"}, set()):
        want = []
        for tokens in docs:
            out, i = [], 0
            while i < len(tokens):
                step = 2 if " ".join(tokens[i : i + 2]) in known else 1
                out.append("_".join(tokens[i : i + step]))
                i += step
            want.append(out)
        frame = spark.createDataFrame([(i, d, "k") for i, d in enumerate(docs)], "doc_id bigint, tokens array<string>, pos string")
        phrases = spark.createDataFrame([(*p.split(), 9) for p in known], "a string, b string, n_ab bigint")
        merged = PH.merge_phrases(frame, phrases)
        assert [r.tokens for r in merged.orderBy("doc_id").collect()] == want and merged.columns == frame.columns
        assert "Python" not in merged._jdf.queryExecution().toString() and "InPandas" not in merged._jdf.queryExecution().toString()


def test_empty_tokens_have_no_bag(spark):
    assert D.term_rows(docs_of(spark, ""), ["doc_id"]).count() == 0
    assert C.drop_empty(docs_of(spark, "", "a")).count() == 1


def test_grid_sizes(spark):
    grid = GR.hyperparameter_grid(spark)
    axes = ["topics", "alpha_str", "beta_str", "type"]
    drawn = GR.sample_grid(grid, axes, 1)
    assert grid.count() == 1260 and drawn.count() == 472
    assert GR.undrawn(grid, drawn).count() == 1260 - 472
    assert GR.hyperparameter_grid(spark, gamma=True).count() == 12600
    assert GR.sample_grid(grid.limit(2), axes, 1).count() == 1
    batches = spark.range(3).withColumnRenamed("id", "batch_id")
    assert GR.with_grid(batches, drawn, axes).count() == 3 * 472


def test_window_and_document_counts_by_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [[rng.choice(words + [None, "x", "y"]) for _ in range(rng.choice([0, 1, 5, 6, 7, 60]))] for _ in range(40)]
    topics = [(f"t{t}", w) for t in range(5) for w in rng.sample(words, rng.choice([1, 3, 8]))] + [("far", "unseen"), ("far", "w1")]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id bigint, tokens array<string>")
    table = spark.createDataFrame(topics, "topic string, term string")
    want = {}
    for topic in {t for t, _ in topics}:
        own = sorted(w for t, w in topics if t == topic)
        for i, a in enumerate(own):
            for b in own[i:]:
                windows = sum({a, b} <= set(d[k : k + 6]) for d in docs for k in range(max(1, len(d) - 5)))
                held = sum({a, b} <= set(d) for d in docs)
                if held:
                    want[topic, a, b] = (windows, held)
    for block_tokens, rows in ((1 << 20, 1 << 18), (50, 4)):
        CO.SLICE_ROWS = rows
        packed = CO.pack_sequences(frame, block_tokens=block_tokens)
        got = {(r.topic, r.a, r.b): (r.n_windows, r.n_docs) for r in CO.pair_counts(packed, table, 6).collect()}
        assert got == want
    CO.SLICE_ROWS = 1 << 18
    assert CO.total_windows(frame, window=6).first()[0] == CO._totals(packed, 6)[0] and CO._totals(packed, 6)[1] == 40


def test_both_measures_from_one_pass(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "c"][: i % 3 + 1] * 5) for i in range(12)], "doc_id bigint, tokens array<string>")
    topics = spark.createDataFrame([(t, w, p + 1) for t, ws in ((0, "abc"), (1, "ab")) for p, w in enumerate(ws)], "topic int, term string, place_in_topic int")
    both = {r.topic: r for r in CO.coherence(docs, topics).collect()}
    assert both[0].c_v == {r.topic: r.c_v for r in CO.coherence_cv(docs, topics).collect()}[0]
    assert {(r.topic, r.u_mass, r.place) for r in CO.coherence_umass(docs, topics).collect()} == {(t, r.u_mass, r.place) for t, r in both.items()}


def test_umass_by_hand(spark):
    docs = docs_of(spark, "a b", "a", "a b c", "c")
    topics = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "c", 1), (1, "a", 2)], "topic int, term string, place_in_topic int")
    got = {r.topic: (r.u_mass, r.place) for r in CO.coherence_umass(docs, topics).collect()}
    assert math.isclose(got[0][0], math.log(2 / 3), abs_tol=1e-9) and got[0][1] == 1
    assert math.isclose(got[1][0], math.log(1 / 2), abs_tol=1e-9)


def test_cv_is_bounded_and_prefers_words_that_meet(spark):
    docs = docs_of(spark, *["a b c"] * 10, *["x"] * 10, *["y"] * 10, *["z"] * 10)
    topics = spark.createDataFrame([(0, w) for w in "abc"] + [(1, w) for w in "xyz"], "topic int, term string")
    got = {r.topic: r.c_v for r in CO.coherence_cv(docs, topics).collect()}
    assert math.isclose(got[0], 1, abs_tol=1e-6) and -1 <= got[1] < got[0]


def test_classical_scaling_keeps_distances():
    corners = np.array([[0, 0], [4, 0], [4, 3], [0, 3]], dtype=float)
    d = np.linalg.norm(corners[:, None] - corners[None], axis=2)
    at = G.classical_scaling(d)
    assert np.allclose(np.linalg.norm(at[:, None] - at[None], axis=2), d)


def test_js_distance_and_pcoa(spark):
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])], "b int, i int, distribution array<double>")
    pairs = {(r.i_1, r.i_2): r.js for r in G.js_distance(rows, ["b"], "i").collect()}
    assert math.isclose(pairs[(0, 1)], math.log(2)) and all(0 <= v <= math.log(2) + 1e-12 for v in pairs.values())
    assert G.pcoa_2d(rows, ["b"], "i").count() == 3


def test_explore_join_shuffles_numbers_of_texts(spark, monkeypatch):
    real, calls = F.xxhash64, []

    def poor(*columns):  # the first seed gives texts of one length one number
        calls.append(columns)
        return F.length("text_sha256").cast("bigint") if len(calls) == 1 else real(*columns)

    rng = random.Random(3)
    rows = [
        (i, rng.choice("ab"), rng.choice(["x1", "x2", "long", None]), rng.choice([0.1, None]), "al", rng.choice([0.5, 0.7]), "be", rng.choice([5, 10, None]))
        for i in range(60)
    ]
    names = ["key", "type", "text_sha256", "n_alpha", "alpha_str", "n_beta", "beta_str", "topics"]
    runs = spark.createDataFrame(rows, "key int, type string, text_sha256 string, n_alpha double, alpha_str string, n_beta double, beta_str string, topics int")
    monkeypatch.setattr(F, "xxhash64", poor)
    number, texts = R.text_numbers(runs)
    assert len(calls) == 2 and texts.count() == 4 and texts.select("_text").distinct().count() == 4
    calls.clear()
    got = R.explore_join(runs, ["key"])
    found = sorted(repr(tuple(r)) for r in got.collect())

    runs = [dict(zip(names, r)) for r in rows]
    models = {tuple(r[c] for c in ("type", "topics", "n_alpha", "n_beta")): 0 for r in runs}
    for r in runs:
        models[tuple(r[c] for c in ("type", "topics", "n_alpha", "n_beta"))] += 1
    combinations = {tuple(r[c] for c in ("type", "topics", "text_sha256", "n_alpha", "n_beta")) for r in runs}
    joined = [
        (r["type"], r["text_sha256"], r["text_sha256"], r["alpha_str"], r["beta_str"], t, models[(k, t, a, b)])
        for r in runs
        for k, t, s, a, b in combinations
        if (k, s, a, b) == (r["type"], r["text_sha256"], r["n_alpha"], r["n_beta"])
    ]
    of = lambda j: [x for x in joined if x[:2] == j[:2]]
    want = sorted(repr((*j[:5], len(of(j)), sum(x[6] for x in of(j)), *j[5:])) for j in joined)
    assert found == want
