"""The flows from files to reports, on small inputs."""

import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from topicloom import schemas
from topicloom.operators import batch_models as B
from topicloom.operators import grid as GR
from topicloom.plans import flows
from topicloom.sources import readers as IN


def test_corpus_from_zips(spark, tmp_path):
    (tmp_path / "json" / "html").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "json" / "html" / "mmwr_art_en_html_json.zip", "w") as z:
        z.writestr("mmwr_art_en_html.json", json.dumps({f"u{i}": f"<p>{i}</p>" for i in range(5)}))
    lines = [",".join(schemas.CORPUS_COLUMNS)]
    for i, (level, lang, date) in enumerate([("article", "en", "2015-03-01"), ("article", "EN", "2016-04"), ("issue", "en", "2016-01-01"), ("article", "fr", "2016-01-01"), ("article", "en", "")]):
        known = {"url": f"u{i}", "level": level, "lang": lang, "dl_date": date}
        lines.append(",".join(known.get(c, "") for c in schemas.CORPUS_COLUMNS))
    (tmp_path / "meta.csv").write_text("\n".join(lines) + "\n")
    rows = flows.prepare_corpus(spark, str(tmp_path / "json"), str(tmp_path / "meta.csv"), str(tmp_path / "out"))
    assert sorted((r.url, r.content, r.year) for r in rows.collect()) == [("u0", "<p>0</p>", 2015), ("u1", "<p>1</p>", 2016)]


def test_training_and_reports(spark, tmp_path):
    rng = np.random.RandomState(3)
    rows = [(d, list(map(str, rng.choice([f"{'ab'[d % 2]}{i}" for i in range(8)], 20)))) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    grid = GR.product(spark, {"topics": [2, 3], "alpha_str": ["symmetric", "0.31"], "beta_str": ["symmetric"], "type": ["eval", "train"]})
    runs = flows.train_grid(docs, str(tmp_path), grid=grid, batch_size=8, passes=1)
    n = runs.count()
    drawn = GR.sample_grid(grid, ["topics", "alpha_str", "beta_str", "type"], 75).count()
    assert n == drawn * 3  # train batches of 8 and 8, one eval batch of 4
    assert dict(runs.dtypes) == schemas.MODEL_RUNS
    assert runs.filter("create_pcoa AND num_documents = %d" % n).count() == n
    artifacts = IN.read_artifacts(spark, str(tmp_path / "artifacts"))
    assert artifacts.count() == len(schemas.ARTIFACT_KINDS) * n
    assert {r.kind: r.n for r in spark.read.parquet(str(tmp_path / "artifacts" / "payloads")).groupBy("kind").agg(F.count("*").alias("n")).collect()} == {
        **dict.fromkeys(("text", "text_json", "corpus"), 3), "dictionary": 1 + (rows[0][1] != rows[1][1]), "lda_model": len({(r.topics, r.alpha_str) for r in runs.collect()}) * 3
    }
    again = {r.time_key: r for r in B.stored_scores(artifacts).collect()}
    assert all(np.isclose(again[r.time_key].convergence, r.convergence, rtol=1e-6) for r in runs.collect()) and len(again) == n
    models = B.model_rows(artifacts)
    assert models.select("time_key").distinct().count() == n
    flags = runs.filter("create_pylda").count()
    assert flags == n and spark.read.parquet(str(tmp_path / "topic_tables")).select("time_key").distinct().count() == n
    assert IN.load_texts_by_score(runs, artifacts, -2.0).count() == n
    reports = flows.analyse_runs(runs)
    assert reports["explore"].count() >= n
    assert reports["train_moments"].count() == 2 * 3 and reports["eval_quantiles"].count() == 3
    assert all(r.columns for r in reports.values())
