"""Topic models: planted topics are found, runs repeat, bounds behave."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicloom import schemas
from topicloom.operators import batch_models as B
from topicloom.operators import coherence as CO
from topicloom.operators import corpus_models as CM
from topicloom.operators import dictionary as D
from topicloom.operators import geometry as G
from topicloom.operators import grid as GR
from topicloom.operators import online as ON
from topicloom.operators import topic_models as TM
from topicloom.operators import variational as V
from topicloom.plans import model_queries as MQ
from topicloom.plans import text_queries as TQ
from topicloom.runtime import materialize
from topicloom.sources import writers as OUT

VOCABULARIES = [[f"{c}{i}" for i in range(10)] for c in ("aa", "bb", "cc")]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.RandomState(7)
    rows = [(d, list(map(str, rng.choice(VOCABULARIES[d % 3], 40)))) for d in range(60)]
    return materialize(spark.createDataFrame(rows, "doc_id bigint, tokens array<string>"), "planted")


def pure(words):
    return len({w[:2] for w in words}) == 1


def check_topics(rows):
    """Every topic draws its top words from one vocabulary and all three are found."""
    assert all(pure(words) for words in rows)
    assert {words[0][:2] for words in rows} == {"aa", "bb", "cc"}


def test_corpus_model(spark, planted):
    packed = CM.pack(planted)
    found = False
    for seed in (75, 76, 77):  # a random start may merge two topics
        model = TM.fit_topics(packed, 3, 0.1, 0.1, passes=15, seed=seed)
        top = {}
        for r in model.topic_words(8).collect():
            top.setdefault(r.topic, []).append(r.term)
        found |= all(pure(w) for w in top.values()) and len({w[0][:2] for w in top.values()}) == 3
    assert found
    shares = model.doc_topics(packed).collect()
    assert len(shares) == 60 and all(abs(sum(r.distribution) - 1) < 1e-6 and r.n_tokens == 40 for r in shares)
    phi = G.topic_word_matrix(model.topic_words()).groupBy("topic").agg(F.sum("phi").alias("s")).collect()
    assert len(phi) == 3 and all(abs(r.s - 1) < 1e-9 for r in phi)
    short = TM.fit_topics(packed, 3, 0.1, 0.1, passes=1).scores(packed).first()
    long = model.scores(packed).first()
    assert long.per_word_bound > short.per_word_bound
    assert abs(long.perplexity_base2 - 2**-long.per_word_bound) < 1e-9


def dense_fit(rows, model, start, passes):
    """The same model on one dense matrix, by the helper of the batch models."""
    terms, ids, counts, indptr, _, _ = V.compress(rows)
    weights = np.array([start[t] for t in terms]).T
    for step in range(passes):
        beta = np.exp(V.expected_log(weights)).T
        _, expected = V.infer(indptr, counts, beta[ids], model.prior(), 50)
        stats = np.zeros((len(terms), model.k))
        np.add.at(stats, ids, expected)
        rho = (model.offset + step) ** -model.decay
        weights = (1 - rho) * weights + rho * (model.eta + stats.T)
    log_beta = V.expected_log(weights).T
    gamma, _ = V.infer(indptr, counts, np.exp(log_beta)[ids], model.prior(), 50)
    bound = V.document_bounds(indptr, counts, log_beta[ids], gamma, model.prior()).sum() + V.topic_bound(weights, model.eta)
    return dict(zip(terms, weights.T)), bound


def test_blocks_and_models_side_by_side_change_nothing(spark, planted):
    """Several models with 40 topic columns over small blocks equal a dense fit of each."""
    models = [CM.Model(3, 0.1, 0.1), CM.Model(33, 0.3, 0.2, 0.7, 10.0), CM.Model(4, (0.1, 0.2, 0.3, 0.4), 0.1)]
    packed = CM.pack(planted, block_tokens=100)
    assert packed.count() > 8
    start = materialize(CM.start_weights(CM.packed_terms(packed), models, 75), "start")
    weights = CM.fit(packed, models, passes=3)
    scores = {r.model: r for r in CM.corpus_scores(packed, weights, models).collect()}
    rows = [list(r.tokens) for r in planted.orderBy("doc_id").collect()]
    for i, model in enumerate(models):
        def table(of):
            out = {}
            for r in CM.topic_rows(of, models, i).collect():
                out.setdefault(r.term, np.zeros(model.k))[r.topic] = r.weight
            return out

        want, bound = dense_fit(rows, model, table(start), 3)
        got = table(weights)
        assert got.keys() == want.keys() and all(np.allclose(got[t], want[t]) for t in got)
        assert np.isclose(scores[i].bound, bound) and scores[i].n_docs == 60 and scores[i].n_tokens == 2400


def test_the_corpus_model_makes_all_passes(spark, planted, monkeypatch):
    monkeypatch.setattr(MQ, "documents", lambda *_: planted)
    made = []
    monkeypatch.setattr(CM, "advance", lambda packed, weights, models, steps, *a, **b: made.append(list(steps)) or weights)
    MQ.corpus_model(spark, "")
    assert made == [list(range(15))]


def test_a_fold_takes_nothing_from_its_documents(spark, planted):
    packed = CM.pack(planted, folds=3)
    folds = {d: f for r in packed.collect() for d, f in zip(r.doc_ids, r.folds)}
    models = [CM.Model(2, 0.1, 0.1, fold=f) for f in range(3)]
    weights = CM.fit(packed, models, passes=2)
    scores = {(r.model, r.held_out): r for r in CM.corpus_scores(packed, weights, models).collect()}
    for f in range(3):
        rows = planted.filter(F.col("doc_id").isin([d for d in folds if folds[d] != f]))
        counts = {r.term: r.n for r in rows.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        sums = {r.term: r.w for r in CM.topic_rows(weights, models, f).groupBy("term").agg(F.sum("weight").alias("w")).collect()}
        assert all(np.isclose(sums[t], counts.get(t, 0) + 0.2) for t in sums)
        assert scores[f, True].n_docs == sum(x == f for x in folds.values())


def test_odd_documents(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (None, ["b", None, "c"]), (4, ["a"] * 5000), (4, ["a"] * 5000)]
    packed = CM.pack(spark.createDataFrame(rows, "doc_id bigint, tokens array<string>"), block_tokens=10)
    model = TM.fit_topics(packed, 2, 0.5, 0.1, passes=2)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(sum(r.distribution), 6), r.per_word_bound is None) for r in model.doc_topics(packed).collect())
    assert got == [(-1, 2, 1.0, False), (1, 3, 1.0, False), (2, 0, 1.0, True), (3, 0, 1.0, True), (4, 5000, 1.0, False), (4, 5000, 1.0, False)]
    assert {r.term for r in model.topic_words().collect()} == {"a", "b", "c"}
    unseen = CM.pack(spark.createDataFrame([(9, ["a", "zzz"]), (10, ["zzz"])], "doc_id bigint, tokens array<string>"))
    assert sorted((r.doc_id, r.n_tokens) for r in model.doc_topics(unseen).collect()) == [(9, 1), (10, 0)]
    empty = CM.pack(spark.createDataFrame([], "doc_id bigint, tokens array<string>"))
    assert CM.fit(empty, [CM.Model(2, 0.1, 0.1)], passes=1).count() == 0


def test_vectors_of_any_vocabulary(spark, planted):
    vectors = D.count_vectorize(planted, materialize(D.build_dictionary(planted), "dictionary"))
    assert {int(v.features.values.sum()) for v in vectors.collect()} == {40} and vectors.first().features.size == 30


def test_column_sums_are_added_up_by_column(spark, planted, monkeypatch):
    monkeypatch.setattr(TQ, "token_table", lambda *_: planted)
    sums = TQ.count_vectorize(spark, "")
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate_metrics" not in plan  # which holds a number for each term in one row
    counts = planted.select("doc_id", F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*"), F.countDistinct("doc_id"))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, counts.collect()))


def batches(planted, size=30):
    return planted.select(
        F.lit("train").alias("split"), F.floor(F.col("doc_id") / size).alias("batch_id"), F.pmod("doc_id", F.lit(size)).alias("pos"), "doc_id", "tokens"
    )


def point(spark, k=3):
    return GR.product(spark, {"topics": [k], "alpha_str": ["symmetric"], "beta_str": ["0.31"], "type": ["train"]})


def test_batch_models(spark, planted):
    fits = materialize(B.fit_per_batch(batches(planted, 60), point(spark), passes=20), "fits")
    row = fits.first()
    check_topics([w[:8] for w in row.top_words])
    assert -1 <= row.coherence <= 1 and row.n_docs == 60 and row.chunksize == 12
    assert list(row.topic_coherence) == sorted(row.topic_coherence, reverse=True)
    again = B.fit_per_batch(batches(planted, 60), point(spark), passes=20).first()
    assert again.convergence == row.convergence and again.top_words == row.top_words
    worse = B.fit_per_batch(batches(planted, 60), point(spark), passes=1).first()
    assert row.perplexity > worse.perplexity
    shares = B.doc_topic_rows(fits).collect()
    assert len(shares) == 60 and all(abs(sum(r.distribution) - 1) < 1e-9 for r in shares)


def test_every_drawn_combination_meets_every_batch(spark, planted):
    axes = {"topics": [2, 3], "alpha_str": ["symmetric", "asymmetric"], "beta_str": ["symmetric"], "gamma": [0.001, 0.2], "type": ["eval", "train"]}
    grid = GR.product(spark, axes)
    columns = [*B.run_key_columns(), "convergence"]
    one = B.fit_per_batch(batches(planted), grid, passes=1).select(*columns).collect()
    many = B.fit_per_batch(batches(planted), grid, passes=1, cells=1).select(*columns).collect()
    assert len(one) == 16 * 2 and sorted(one) == sorted(many)
    fits = {}
    for r in one:
        fits.setdefault((r.batch_id, r.topics, r.alpha_str, r.gamma), set()).add((r.drawn_type, r.convergence))
    assert all({t for t, _ in v} == {"eval", "train"} and len({c for _, c in v}) == 1 for v in fits.values())
    gammas = {k: next(iter(v))[1] for k, v in fits.items()}
    assert any(gammas[k] != gammas[(*k[:3], 0.001)] for k in gammas)  # the threshold reaches the fit


def test_the_full_draw_is_queued_in_slices_of_like_cost(spark, planted):
    drawn = materialize(GR.sample_grid(GR.hyperparameter_grid(spark), ["topics", "alpha_str", "beta_str", "type"], 75), "drawn")
    queue = B.work_queue(batches(planted), drawn, cells=1 << 20).collect()
    assert len(queue) > 4
    for batch in (0, 1):
        points = [p for r in queue if r.batch_id == batch for p in r.points]
        assert sum(len(p.drawn_types) for p in points) == drawn.count() == 472
        assert len({(p.topics, p.alpha_str, p.beta_str) for p in points}) == len(points) < 472
    n = 30 * 40
    assert all(sum(p.topics for p in r.points) * n <= (1 << 20) + 120 * n for r in queue)


def test_topic_tables_of_fitted_batches(spark, planted):
    fits = materialize(B.fit_per_batch(batches(planted), point(spark), passes=3, keep_weights=True).withColumn("time_key", B.run_time_key()), "fits")
    rows = B.topic_tables(fits, n=5).collect()
    assert len(rows) == 2 * 3 * 5
    for r in fits.collect():
        phi = np.array(r.weights) / np.array(r.weights).sum(axis=1, keepdims=True)
        shares = np.array(r.doc_topics).mean(axis=0)  # all documents are equally long
        for x in (x for x in rows if x.time_key == r.time_key):
            at = list(r.terms).index(x.term)
            assert np.isclose(x.phi, phi[x.topic, at]) and np.isclose(x.share, shares[x.topic])
            assert np.isclose(x.relevance, 0.6 * np.log(x.phi) + 0.4 * np.log(x.phi / (shares @ phi)[at]))


def test_cumulative_and_vector_prior(spark, planted):
    rows = B.fit_per_batch(batches(planted), point(spark), passes=1, step_size=10).collect()
    assert sorted((r.batch_id, r.n_docs) for r in rows) == [(b, n) for b in (0, 1) for n in (10, 20, 30)]
    grid = GR.product(spark, {"topics": [3], "alpha_str": ["asymmetric"], "beta_str": ["symmetric"], "type": ["train"]})
    scalar = B.fit_per_batch(batches(planted), grid, passes=1).collect()
    vector = B.fit_per_batch(batches(planted), grid, passes=1, vector_prior=True).collect()
    assert {r.convergence for r in scalar}.isdisjoint({r.convergence for r in vector})


def test_coherence_of_cumulative_models_against_the_whole_corpus(spark, planted):
    fits = materialize(B.fit_per_batch(batches(planted), point(spark), passes=1, step_size=20), "fits")
    topics = materialize(B.topic_term_rows(fits), "topics")
    scores = CO.coherence_cv(planted, topics).collect()
    assert len(scores) == 2 * 2 * 3 and all(-1 <= r.c_v <= 1 for r in scores)
    assert CO.coherence_umass(planted, topics).count() == 12


def test_run_rows_follow_the_schema(spark, planted):
    work = batches(planted)
    fits = materialize(B.fit_per_batch(work, point(spark), passes=1), "fits")
    rows = B.train_run_rows(fits, D.batch_fingerprint(work, ["split", "batch_id"], "pos"), 60, 8, 2, passes=1)
    assert dict(rows.dtypes) == schemas.MODEL_RUNS
    assert rows.select("time_key").distinct().count() == 2
    artifacts = OUT.artifact_rows(rows, {"text": F.col("text_md5")})
    assert artifacts.count() == 2


def test_yearly_updates(spark, planted):
    docs = planted.withColumn("year", (F.col("doc_id") % 2 + 2015).cast("int"))
    model, packed = CM.Model(3, 0.1, 0.1), CM.pack(planted)

    def scores(passes):
        return CM.document_topics(packed, ON.fit_yearly(docs, [2015, 2014, 2016], model, passes=passes), [model])

    short, long = (ON.mean_doc_bound(scores(p)).first() for p in (1, 12))
    assert long.mean_doc_bound > short.mean_doc_bound and long.n_docs == 60
    with pytest.raises(ValueError):
        ON.fit_yearly(docs, [1999], model)


def test_new_terms_enter_with_the_next_year(spark, planted):
    model = [CM.Model(2, 0.1, 0.1)]
    first = CM.with_new_terms(None, CM.pack(planted.filter("doc_id % 3 = 0")), model)
    grown = {r.term: r.weights for r in CM.with_new_terms(first, CM.pack(planted), model).collect()}
    assert len(grown) == 30
    assert all(grown[r.term] == r.weights for r in first.collect())


def test_grid_search(spark, planted):
    results = CM.grid_search(planted, [2, 3], [0.1], [0.1], decays=(0.5, 0.9), folds=2, passes=2)
    assert results.count() == 8
    best = TM.best_point(results).collect()
    assert len(best) == 4 and best[0].mean_score == max(r.mean_score for r in best) and best[0].n_splits == 2


def test_one_scan_of_the_documents_a_pass(spark, planted):
    packed = CM.pack(planted, folds=10)
    models = [CM.Model(k, 0.1, 0.1, fold=f) for k in (2, 3) for f in range(10)]
    weights = materialize(CM.start_weights(CM.packed_terms(packed), models, 75), "start")
    plan = CM.expected_counts(packed, weights, models)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("doc_ids#") >= 1 and plan.count("FlatMapCoGroupsInArrow") == 1


def test_the_first_pass_of_a_grid_shares_its_inference(spark, planted):
    models = [CM.Model(2, 0.1, 0.1, d, fold=f) for d in (0.5, 0.9) for f in (0, 1, None)] + [CM.Model(3, 0.1, 0.1)]
    packed = CM.pack(planted, folds=3)
    weights = CM.materialize(CM.start_weights(CM.packed_terms(packed), models, 75), "weights")
    tables = [{(r.term, r.part): r.stats for r in CM.expected_counts(packed, weights, models, alike=x).collect()} for x in (False, True)]
    assert tables[0].keys() == tables[1].keys()
    assert all(np.allclose(tables[0][key], tables[1][key]) for key in tables[0])


def test_many_models_meet_a_block_some_columns_at_a_time(spark, planted, monkeypatch):
    """No block gets the columns of all models of a grid, and the numbers are those of all together."""
    models = [CM.Model(k, 0.1, 0.1, d, fold=f) for k in (3, 5) for d in (0.5, 0.7, 0.9) for f in range(10)]
    packed = CM.pack(planted, folds=10)
    sent, send = [], CM.Routes.sent
    monkeypatch.setattr(CM.Routes, "sent", lambda *args: sent.append(send(*args)) or sent[-1])
    weights = CM.fit(packed, models, passes=2)
    scores = sorted(map(tuple, CM.corpus_scores(packed, weights, models).collect()))
    assert len(sent) == 3 and all(0 < s.select(F.max(F.length("weights") / (F.length("local") * 2))).first()[0] <= 64 for s in sent)
    monkeypatch.setattr(CM, "GROUP_COLUMNS", 1 << 20, raising=False)
    again = CM.fit(packed, models, passes=2)
    assert np.allclose(scores, sorted(map(tuple, CM.corpus_scores(packed, again, models).collect())))
    assert sum(len(members) for members, _ in CM.Columns([CM.Model(100, 0.1, 0.1)] * 3).groups()) == 3


def test_inference_of_documents_together_is_that_of_each_alone():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 40, 60)
    indptr, alpha = np.append(0, np.cumsum(sizes)), np.array([0.05, 0.2, 0.5])
    counts, beta = rng.integers(1, 9, indptr[-1]).astype(float), rng.dirichlet([0.3, 0.3, 0.3], indptr[-1]) + 1e-9
    gamma, expected = V.infer(indptr, counts, beta, alpha)
    assert np.allclose(expected.sum(axis=1), counts)
    for d, (a, b) in enumerate(zip(indptr[:-1], indptr[1:])):
        alone, own = V.infer(np.array([0, b - a]), counts[a:b], beta[a:b], alpha)
        assert np.allclose(gamma[d], alone[0]) and np.allclose(expected[a:b], own)
    assert abs(V.digamma(np.array(1.0)) + 0.5772156649015329) < 3e-12


def test_single_documents_are_fitted_side_by_side(spark, monkeypatch):
    """The numbers are those of a fit for each document alone, however many stand side by side."""
    rng = np.random.RandomState(5)
    docs = [(i, [f"w{x}" for x in rng.randint(0, 30, n)]) for i, n in enumerate([1, 2, 3, 40, 200, 90, 7, 60])]
    settings = (3, 50, 0.5, 1.0, True, True)
    points = [
        {"topics": k, "alpha_str": a, "beta_str": "0.31", "gamma": 0.001, "drawn_types": [None], "n_alpha": 0.2, "n_beta": 0.31}
        for k, a in ((2, "0.2"), (5, "asymmetric"))
    ]
    alone = {}
    for i, words in docs:
        for p in points:
            alone[(i, p["topics"])] = B._fit_one([words], V.compress([words]), p, *settings)

    inferred = []
    monkeypatch.setattr(V, "infer", lambda *args, infer=V.infer: inferred.append(1) or infer(*args))
    frame = pd.DataFrame(
        {"split": "train", "batch_id": [i for i, _ in docs], "documents": [[{"pos": 0, "doc_id": i, "tokens": t}] for i, t in docs], "points": [points] * len(docs)}
    )
    rows = pd.concat(list(B._trainer(None, settings)(iter([frame]))))
    assert len(inferred) == 2 * (3 + 1), "one inference a pass for all documents of a point"
    assert len(rows) == len(alone)
    for row in rows.itertuples():
        want = alone[(row.batch_id, row.topics)]
        assert row.doc_ids == [row.batch_id] and row.step == 0 and row.top_words == want["top_words"] and row.terms == want["terms"]
        for c in ("convergence", "perplexity", "coherence"):
            assert getattr(row, c) == pytest.approx(want[c], rel=1e-9)
        assert np.allclose(row.weights, want["weights"], rtol=1e-9) and np.allclose(row.doc_topics, want["doc_topics"], rtol=1e-9)


def test_a_pass_sends_one_row_for_a_bucket_and_block(spark):
    """Weights travel by the bucket, not by the term, and come back as they were; terms without weights have no way."""
    rng = np.random.RandomState(3)
    rows = [(d, [f"w{x}" for x in rng.randint(0, 3000, 200)]) for d in range(40)]
    packed = CM.pack(spark.createDataFrame(rows, "doc_id bigint, tokens array<string>"), block_tokens=1000)
    models = [CM.Model(2, 0.1, 0.1), CM.Model(33, 0.1, 0.1)]
    weights = materialize(CM.start_weights(CM.packed_terms(packed).filter("term <> 'w7'"), models, 75), "start")
    columns = CM.Columns(models)
    routes = CM.route(packed, weights, columns.parts, columns.width)
    sent = routes.sent(routes.weights).collect()
    blocks = {r.block: r for r in packed.collect()}
    pairs = sum(len(set(r.terms) - {"w7"}) for r in blocks.values())
    assert sum(len(r.local) // 4 for r in sent) == pairs and len(sent) * 5 < pairs
    want = {(r.term, r.part): list(r.weights) for r in weights.collect()}
    for r in sent:
        found = np.frombuffer(r.weights).reshape(-1, columns.parts, columns.width)
        for local, table in zip(np.frombuffer(r.local, np.int32), found):
            assert all(list(table[p]) == want[blocks[r.at_block].terms[local], p] for p in range(columns.parts))
    assert {(r.term, r.part): list(r.weights) for r in routes.rows(routes.weights, "weights", columns.width).collect()} == want


def test_buckets_go_to_python_one_by_one(spark, planted):
    packed, models = CM.pack(planted), [CM.Model(2, 0.1, 0.1)]
    weights = materialize(CM.start_weights(CM.packed_terms(packed), models, 75), "start")
    routes = CM.route(packed, weights, 1, 2)
    for df in (routes.sent(routes.weights), routes.rows(routes.weights, "weights", 2), CM.expected_counts(packed, weights, models)):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    totals = sum(np.frombuffer(r.totals) for r in routes.weights.collect())
    assert np.allclose(totals, CM.column_totals(weights, CM.Columns(models)))


def test_documents_of_like_size_are_inferred_as_tables(monkeypatch):
    """Large inputs take two matrix products a step and give the numbers of the columns; documents without entries keep the prior."""
    rng = np.random.default_rng(6)
    sizes = np.append(rng.integers(1, 300, 600), [0, 5000])
    indptr, alpha = np.append(0, np.cumsum(sizes)), np.array([0.05, 0.2, 0.5])
    counts, beta = rng.integers(1, 9, indptr[-1]).astype(float), rng.dirichlet([0.3, 0.3, 0.3], indptr[-1]) + 1e-9
    products = []
    monkeypatch.setattr(V.np, "matmul", lambda *args, product=np.matmul, **named: products.append(1) or product(*args, **named))
    gamma, expected = V.infer(indptr, counts, beta, alpha)
    assert products
    filled = sizes > 0
    columns, own = V._infer_columns(np.append(0, np.cumsum(sizes[filled])), counts, beta, alpha, 50, 1e-3)
    assert np.allclose(gamma[filled], columns) and np.allclose(expected, own) and np.allclose(gamma[~filled], alpha)


def test_batches_of_a_task_are_fitted_side_by_side(monkeypatch):
    """The numbers are those of a fit for each batch alone, whatever their sizes and steps, from one inference a step for all."""
    rng = np.random.RandomState(5)
    batches = [(b, [[f"w{x}" for x in rng.randint(0, 200, 60)] for _ in range(n)]) for b, n in enumerate([50, 50, 23, 2, 31])]
    settings = (3, 50, 0.5, 1.0, True, True)
    points = [
        {"topics": k, "alpha_str": a, "beta_str": "0.31", "gamma": 0.001, "drawn_types": [None], "n_alpha": 0.2, "n_beta": 0.31}
        for k, a in ((2, "0.2"), (5, "asymmetric"))
    ]
    alone, steps = {}, 0
    for b, docs in batches:
        for end in [*range(25, len(docs), 25), len(docs)]:
            packed = V.compress(docs[:end])
            terms, ids, counts, indptr, _, _ = packed
            for p in points:
                k, alpha = p["topics"], B._prior(p, True)
                weights = V.fit(ids, counts, indptr, len(terms), k, alpha, 0.31, 3, 50, B.UPDATE_EVERY, max(1, end // 5), B.RANDOM_STATE, 0.5, 1.0, 0.001)
                gamma, _ = V.infer(indptr, counts, np.exp(V.expected_log(weights)).T[ids], alpha, 50, 0.001)
                alone[(b, end, k)] = weights, gamma / gamma.sum(axis=1, keepdims=True)
            steps = max(steps, 3 * -(-end // (max(1, end // 5) * B.UPDATE_EVERY)))

    inferred = []
    monkeypatch.setattr(V, "infer", lambda *args, infer=V.infer: inferred.append(1) or infer(*args))
    documents = [[{"pos": i, "doc_id": i, "tokens": t} for i, t in enumerate(docs)] for _, docs in batches]
    frame = pd.DataFrame({"split": "train", "batch_id": [b for b, _ in batches], "documents": documents, "points": [points] * len(batches)})
    rows = pd.concat(list(B._trainer(25, settings)(iter([frame]))))
    assert len(inferred) == 2 * (steps + 1), "one inference a step for all batches of a point"
    assert sorted((r.batch_id, r.n_docs, r.topics) for r in rows.itertuples()) == sorted(alone)
    for r in rows.itertuples():
        weights, shares = alone[(r.batch_id, r.n_docs, r.topics)]
        assert r.doc_ids == list(range(r.n_docs)) and r.step == (r.n_docs - 1) // 25
        assert np.allclose(r.weights, weights, rtol=1e-9) and np.allclose(r.doc_topics, shares, rtol=1e-9)


def test_tables_of_documents_go_step_by_step_together(monkeypatch):
    """One digamma a step serves all tables of a panel, not each table."""
    rng = np.random.default_rng(8)
    indptr = np.append(0, np.cumsum(rng.integers(1, 400, 120)))
    counts, beta = rng.integers(1, 9, indptr[-1]).astype(float), rng.dirichlet([0.3, 0.3, 0.3], indptr[-1]) + 1e-9
    calls = []
    monkeypatch.setattr(V, "digamma", lambda x, digamma=V.digamma: calls.append(1) or digamma(x))
    gamma, expected = V._infer_by_size(indptr, counts, beta, np.full(3, 0.2), 50, 1e-3)
    assert len(calls) <= 51
    columns, own = V._infer_columns(indptr, counts, beta, np.full(3, 0.2), 50, 1e-3)
    assert np.allclose(gamma, columns) and np.allclose(expected, own)
