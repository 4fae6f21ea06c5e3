"""Readers and writers on small files."""

import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from topicloom import runtime, schemas
from topicloom.operators import corpus as C
from topicloom.plans import source_queries as SQ
from topicloom.sources import readers as IN
from topicloom.sources import writers as OUT
from topicloom.streaming import streams


def test_zipped_collections_last_key_wins(spark, tmp_path):
    for name, content in {"mmwr_art_en": {"u1": "old", "u2": "b"}, "pcd_art_en": {"u1": "new"}}.items():
        folder = tmp_path / "html"
        folder.mkdir(exist_ok=True)
        with zipfile.ZipFile(folder / f"{name}_html_json.zip", "w") as z:
            z.writestr(f"{name}_html.json", json.dumps(content))
    rows = IN.read_collections(spark, str(tmp_path))
    assert {(r.url, r.fmt, r.collection, r.position) for r in rows.collect()} == {
        ("u1", "html", "mmwr_art_en", 0), ("u2", "html", "mmwr_art_en", 1), ("u1", "html", "pcd_art_en", 0),
    }
    assert {r.url: r.content for r in C.merge_collections(rows).collect()} == {"u1": "new", "u2": "b"}


@pytest.mark.parametrize("indent", [None, 1])
def test_tokenized_json(spark, tmp_path, indent):
    (tmp_path / "docs.json").write_text(json.dumps([["a", "b"], [], ["c"]], indent=indent))
    rows = IN.read_tokenized(spark, str(tmp_path), whole_file=indent is not None).orderBy("pos").collect()
    assert [r.tokens for r in rows] == [["a", "b"], [], ["c"]]


def test_yearly_files_must_share_a_type(spark, tmp_path):
    for year, line in ((2015, '["a"]'), (2016, '"text"')):
        (tmp_path / f"year={year}").mkdir()
        (tmp_path / f"year={year}" / "part.txt").write_text(line + "\n")
    with pytest.raises(Exception, match="2016"):
        IN.read_yearly_tokenized(spark, str(tmp_path)).collect()


def test_delimited_runs_with_carriage_returns(spark, tmp_path):
    kinds = {"_index": "string", "type": "string", "topics": "int", "coherence": "double"}
    (tmp_path / "runs.csv").write_bytes(b'_index;type;topics;coherence\r0;"tr;ain";20;0.5\r1;eval\r2;eval;x;0.1\r')
    rows = IN.read_runs_delimited(spark, str(tmp_path), kinds, line_sep="\r").orderBy("_index").collect()
    assert [tuple(r) for r in rows] == [("0", "tr;ain", 20, 0.5, False), ("1", "eval", None, None, False), ("2", "eval", None, 0.1, True)]


def test_run_export_and_table(spark, tmp_path):
    rows = spark.createDataFrame([("k", "train", 20, [["a", "b"], ["c"]])], "time_key string, type string, topics int, top_words array<array<string>>")
    OUT.export_runs_csv(rows, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), sep=";", header=True, escape='"').first()
    assert json.loads(back.top_words) == [["a", "b"], ["c"]]
    OUT.save_runs_table(rows.drop("top_words"), "runs_test", str(tmp_path / "table"))
    assert dict(spark.table("runs_test").dtypes) == schemas.RUNS_TABLE
    assert spark.table("runs_test").first().topics == 20


def test_hashes_of_the_runs_table_stay_coded(spark, tmp_path):
    n, texts = 200_000, 30_000
    rows = spark.range(n, numPartitions=1).select(F.sha2(F.pmod(F.xxhash64("id"), F.lit(texts)).cast("string"), 256).alias("text_sha256"))
    OUT.save_runs_table(rows, "runs_coded", str(tmp_path / "table"))
    size = sum(f.stat().st_size for f in (tmp_path / "table").glob("*.parquet"))
    assert spark.table("runs_coded").agg(F.count_distinct("text_sha256")).first()[0] > 29_000
    assert size < 64 * texts * 2  # plain values take 64 bytes a row


def test_tuning_log(spark, tmp_path):
    rows = spark.createDataFrame([(20, 0.1, 0.2, 0.5, -1.0, -7.0, 3.0)], ", ".join(f"{c} double" if c != "n_topics" else "n_topics int" for c in OUT.TUNING_COLUMNS))
    OUT.export_tuning_results(rows, str(tmp_path / "csv"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first().value.startswith("Number of Topics: 20  |  Alpha: 0.1  |  Beta: 0.2")


def test_runs_csv_schema_has_28_columns():
    assert len(schemas.RUNS_CSV) == 28 and len(schemas.RUNS_CSV_OLD) == 22 and len(schemas.CORPUS_COLUMNS) == 23


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    odd = ["a", "],", '"],', "\\\\", 'x\\"]', "[", "é", "", "],[", "\\n]"]
    lists = [[rng.choice(odd) for _ in range(rng.randrange(9))] for _ in range(400)]
    texts = {"compact.json": json.dumps(lists), "tight.json": json.dumps(lists, separators=(",", ":")), "wide.json": json.dumps(lists, indent=2) + "\n", "apart.json": json.dumps(lists).replace("], [", "] , [") if not any("], [" in w for x in lists for w in x) else "[]", "one.json": json.dumps(lists[:1]), "none.json": "[]\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert spark.read.text(str(tmp_path / "wide.json"), lineSep="],").rdd.getNumPartitions() > 4
        rows = IN.read_token_array(spark, str(tmp_path)).orderBy("file", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        own = [r for r in rows if r.file == name]
        assert [list(r.tokens) for r in own] == json.loads(text) and [r.pos for r in own] == list(range(len(own))), name


def test_an_array_is_cut_at_its_elements_whatever_stands_between(spark, tmp_path, monkeypatch):
    lists = [[f"w{i}", "x]"] for i in range(300)] + [[]]
    for name, comma in {"line.json": "\n,", "blank.json": " , ", "tight.json": ","}.items():
        (tmp_path / name).write_text("[" + comma.join(map(json.dumps, lists)) + "\n]\n")
    (tmp_path / "nulls.json").write_text('[null, ["a"], null\n, ["b]"], [], null]')
    longest, total = [], IN.running_total

    def seen(df, *args, **named):
        longest.extend(df.select(F.max(F.length("value"))).first() if "value" in df.columns else [])
        return total(df, *args, **named)

    monkeypatch.setattr(IN, "running_total", seen)
    rows = IN.read_token_array(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert max(longest) < 30
    for name in ("line.json", "blank.json", "tight.json"):
        assert [(r.pos, list(r.tokens)) for r in rows if r.file == name] == list(enumerate(lists)), name
    assert [r.tokens for r in rows if r.file == "nulls.json"] == [None, ["a"], None, ["b]"], [], None]


def test_the_texts_of_an_array_are_not_written_again(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    lists = [[f"w{rng.randrange(10**9)}" for _ in range(20)] for _ in range(3000)]
    (tmp_path / "in.json").write_text(json.dumps(lists))
    monkeypatch.setattr(runtime, "shared_root", lambda _: str(tmp_path / "kept"))
    rows = IN.read_token_array(spark, str(tmp_path / "in.json"))
    assert sorted((r.pos, list(r.tokens)) for r in rows.collect()) == list(enumerate(lists))
    written = sum(f.stat().st_size for f in (tmp_path / "kept").rglob("*.parquet"))
    assert written < (tmp_path / "in.json").stat().st_size / 10


def test_documents_without_text_are_elements_of_the_array(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a"]), (2, None), (3, []), (4, None)], "doc_id bigint, tokens array<string>").coalesce(1)
    monkeypatch.setattr(SQ, "documents", lambda *_: docs)
    assert sorted((r.n_tokens or 0, r.joined_md5 is None) for r in SQ.read_token_array(spark, "").collect()) == [(0, False), (0, True), (0, True), (1, False)]


def test_streams_resume_without_double_counting(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"]) for i in range(6)], "doc_id bigint, tokens array<string>")
    paths = [str(tmp_path / p) for p in ("in", "out", "state")]
    for part in (docs.filter("doc_id < 3"), docs.filter("doc_id >= 3")):
        part.write.mode("append").parquet(paths[0])
        arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(paths[0])
        streams.stream_dictionary(arriving, paths[1], paths[2]).awaitTermination()
    got = {r.term: (r.cf, r.df) for r in streams.current_dictionary(spark.read.parquet(paths[1])).collect()}
    assert got == {"a": (6, 6), "b": (3, 3)}


def test_run_rows_are_appended_once_and_the_state_shrinks(spark, tmp_path):
    paths = [str(tmp_path / p) for p in ("in", "out", "state")]
    schema = "time_key string, topics int, time timestamp"
    day = [dt.datetime(2024, 1, d) for d in range(1, 30)]
    many = [(f"m{i}", i, day[2]) for i in range(50)]
    kept = []
    for rows in (
        [("k1", 1, day[0]), ("k2", 2, day[0]), ("none", 9, None)],
        [("k2", 2, day[0]), ("k3", 3, day[1]), *many],
        [("k3", 3, day[1]), *many[:20], ("k4", 4, day[20])],
        [("late", 5, day[0]), ("k4", 4, day[20]), ("k5", 5, day[20])],
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[0])
        arriving = spark.readStream.schema(schema).parquet(paths[0])
        query = streams.stream_run_append(arriving, paths[1], paths[2], delay="3 days")
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.time_key, r.topics, r.time) for r in streams.appended_runs(spark, paths[1]).collect())
    assert got == sorted([("k1", 1, day[0]), ("k2", 2, day[0]), ("k3", 3, day[1]), *many, ("k4", 4, day[20]), ("k5", 5, day[20])])
    assert max(kept) >= 50 and kept[-1] <= 3


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from topicloom import runtime

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_root(Session())
