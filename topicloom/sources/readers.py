"""Readers for the harvested corpus, tokenised corpora and model-run tables."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as X
from ..operators.ranking import running_total
from ..runtime import materialize

TOKENS_JSON = "array<array<string>>"


def read_mirror_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing of mirrored files; the percentage text becomes a number."""
    raw = spark.read.schema(schemas.MIRROR).csv(path, header=True, escape='"', timestampFormat="yyyy-MM-dd HH:mm[:ss]")
    return raw.withColumn("compress_pct", X.percent_to_number(F.col("compress_pct")))


def read_corpus_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Article metadata; the four ordered categories are null outside their domain."""
    raw = spark.read.schema(schemas.CORPUS_METADATA).csv(path, header=True, escape='"', multiLine=True)
    domains = {"series": X.SERIES, "level": X.LEVEL, "stratum": X.STRATUM, "collection": X.COLLECTION}
    return raw.withColumns({c: X.in_domain(F.col(c), d) for c, d in domains.items()})


def _zip_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in archive.namelist():
                    stem = posixpath.basename(member).removesuffix(".json")
                    collection, _, fmt = stem.rpartition("_")
                    items = list(json.loads(archive.read(member).decode("utf-8")).items())
                    for at in range(0, len(items), 1000):
                        part = items[at : at + 1000]
                        yield pd.DataFrame(
                            {
                                "url": [k for k, _ in part],
                                "fmt": fmt,
                                "collection": collection,
                                "content": [v for _, v in part],
                                "path": path,
                                "position": range(at, at + len(part)),
                            }
                        )


def unzip_collections(archives: DataFrame) -> DataFrame:
    """(path, content) rows of zipped `{url: text}` objects named <collection>_<fmt>.json -> one row per url."""
    return archives.select("path", "content").mapInPandas(
        _zip_rows, "url string, fmt string, collection string, content string, path string, position bigint"
    )


def read_collections(spark: SparkSession, root: str) -> DataFrame:
    """All `<root>/<fmt>/<collection>_<fmt>_json.zip` files; archives are read in parallel, one task per archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_json.zip").option(
        "recursiveFileLookup", "true"
    ).load(root)
    rows = unzip_collections(files)
    return rows.withColumn("load_order", X.category_ordinal(F.col("collection"), X.COLLECTION))


def read_tokenized(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """JSON arrays of token lists -> file, line, pos, tokens.

    A compact file holds one array per line and splits by line; an indented file needs `whole_file`.
    """
    text = spark.read.text(path, wholetext=whole_file).select(F.col("_metadata.file_name").alias("file"), "value")
    return text.select("file", F.posexplode(F.from_json("value", TOKENS_JSON)).alias("pos", "tokens"))


ARRAY_BLANKS = " \t\n\x0b\f\r"
ARRAY_ELEMENTS = "path string, file string, block long, ahead long, n long, first boolean, begins boolean, ends boolean, value string"


def _outside(value: str) -> str:
    """What stands outside the strings of a piece, which begins outside of one."""
    return "".join(re.sub(r"\\.", "", value, flags=re.S).split('"')[::2])


def _n_elements(value: str) -> int:
    """How many elements a piece holds: one list, after and before which some may stand that are no lists."""
    if value.startswith("[") or not value:
        return int(bool(value))
    return _outside(value).split("[")[0].count(",") + 1


def _array_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a block in their order, put together where a bracket stood inside a string.

    `ahead` counts the elements of the block's pieces between its first one and this. A piece that the block's edge cuts has only its begin or end
    here, or neither.
    """
    at, rows, held, ahead, odd, first, begins = None, [], [], 0, False, True, True

    def piece(ends: bool) -> tuple:
        value = "]".join(held)
        if begins:  # the first piece of a file has the bracket of the whole array before its element, the others a comma
            value = value.lstrip(ARRAY_BLANKS).removeprefix("[" if first and at[2] == 0 else ",").lstrip(ARRAY_BLANKS)
        return *at, ahead, _n_elements(value) if begins and ends else 0, first, begins, ends, value

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    schema = pa.schema(list(zip(("path", "file", "block", "ahead", "n", "first", "begins", "ends", "value"), kinds)))
    for batch in batches:
        for path, file, block, inside, quotes, value in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (path, file, block):
                if held:
                    rows.append(piece(False))
                at, held, ahead, odd, first, begins = (path, file, block), [], 0, inside, True, not inside
            held.append(value)
            odd ^= bool(quotes % 2)
            if not odd:
                whole = piece(True)
                if first or whole[-1].strip(ARRAY_BLANKS):
                    rows.append(whole)
                    ahead += 0 if first else whole[4]
                held, first, begins = [], False, True
        if rows:
            yield out()
            rows.clear()
    if held:
        rows.append(piece(False))
        yield out()


def read_token_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that are one JSON array of token lists each, however large -> file, pos (from 0), tokens. A file is read by many tasks.

    The text reader cuts a file at every `]` wherever its byte ranges begin, so a piece holds one element, whatever blanks or line ends stand around
    the commas. A bracket may also stand inside a string; a piece ends inside one if the quotes up to there are odd in number, which a running total
    over the byte ranges tells, and is then put together with the next. Texts stay in the task that reads them: only the first piece of each range, its
    last one if it is cut, and counts are written; the counts have a row for each range, which the driver planned, and are broadcast. A broken element is an
    error when it is read.
    """
    text = spark.read.text(path, lineSep="]")
    quotes = F.regexp_count(F.regexp_replace("value", r"\\.", ""), F.lit('"')).cast("bigint")
    pieces = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), quotes.alias("quotes"), "value",
    )

    def of_block(rows: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
        side = F.broadcast(blocks.select(F.col("path").alias("_p"), F.col("block").alias("_b"), name))
        return rows.join(side, (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b"))).drop("_p", "_b")

    blocks = pieces.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"))
    upto = running_total(blocks, [F.col("block")], ["path"], "quotes", "upto").withColumn("inside", (F.col("upto") - F.col("quotes")) % 2 == 1)
    placed = of_block(pieces, materialize(upto, "blocks"), "inside")
    elements = placed.select("path", "file", "block", "inside", "quotes", "value").mapInArrow(_array_elements, ARRAY_ELEMENTS)

    inner = ~F.col("first") & F.col("ends")
    at_edge = F.collect_list(F.when(~inner, F.struct((~F.col("first")).alias("later"), "begins", "value")))
    edges = elements.groupBy("path", "file", "block").agg(F.sum(F.when(inner, F.col("n")).otherwise(0)).alias("n"), F.array_sort(at_edge).alias("edges"))
    edges = materialize(edges, "edges")
    parts = edges.select("path", "file", "block", F.explode("edges").alias("p")).select("path", "file", "block", "p.*")
    placed = running_total(parts.withColumn("one", F.col("begins").cast("bigint")), [F.col("block"), F.col("later")], ["path"], "one", "chain")
    ordered = F.array_sort(F.collect_list(F.struct("block", "later", "value")))
    chains = placed.groupBy("path", "file", "chain").agg(ordered.alias("parts"))
    chains = chains.select("path", "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["later"].alias("later"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "]").alias("value"),
    ).filter(~F.col("value").rlike(r"^\s*$"))

    def lists(rows: DataFrame, *keep: str) -> DataFrame:
        # A piece without a bracket outside its strings ends at that of the whole array.
        outside = F.filter(F.split(F.regexp_replace("value", r"\\.", ""), '"'), lambda x, i: i % 2 == 0)
        is_list = F.when(F.col("value").startswith("["), True).otherwise(F.exists(outside, lambda x: x.contains("[")))
        parsed = F.from_json(F.concat(F.lit("["), "value", F.when(is_list, "]]").otherwise("]")), TOKENS_JSON, {"mode": "FAILFAST"})
        # A piece holds several elements where some are no lists.
        return rows.select(*keep, F.posexplode(parsed).alias("at", "tokens"))

    joined = materialize(lists(chains, "path", "file", "block", "later"), "chains")
    # The first piece of a block, the pieces between, and the last one if it is cut.
    sizes = edges.select("path", "block", F.lit(1).alias("place"), "n")
    place = F.when(F.col("later"), 2).otherwise(0).alias("place")
    sizes = sizes.unionByName(joined.groupBy("path", "block", place).agg(F.count("*").alias("n")))
    before = running_total(sizes, [F.col("block"), F.col("place")], ["path"], "n", "upto").withColumn("before", F.col("upto") - F.col("n"))
    before = materialize(before, "before")
    found = lists(of_block(elements.filter(inner), before.filter("place = 1"), "before"), "file", (F.col("before") + F.col("ahead")).alias("before"))
    for at in (0, 2):
        rows = of_block(joined.filter(place == at), before.filter(F.col("place") == at), "before")
        found = found.unionByName(rows.select("file", "before", "at", "tokens"))
    return found.select("file", (F.col("before") + F.col("at")).alias("pos"), "tokens")


def count_records(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_documents"))


def read_yearly_tokenized(spark: SparkSession, root: str) -> DataFrame:
    """`year=` folders of token arrays; a line of another type in any year is an error."""
    text = spark.read.schema("value string, year int").text(root)
    parsed = text.withColumn("tokens", F.from_json("value", "array<string>"))
    bad = F.concat(F.lit("not a token list in year "), F.col("year").cast("string"))
    checked = F.when(F.col("tokens").isNull(), F.raise_error(bad).cast("array<string>")).otherwise(F.col("tokens"))
    return parsed.select("year", checked.alias("tokens"))


def read_model_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_runs_delimited(
    spark: SparkSession, path: str, columns: dict[str, str] | None = None, line_sep: str | None = None
) -> DataFrame:
    """`;` file with a header; short lines are padded, a value of the wrong type is null and sets `error`."""
    columns = columns or schemas.RUNS_CSV
    reader = spark.read.schema(", ".join(f"`{c}` STRING" for c in columns))
    options = {"sep": ";", "header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "enforceSchema": True}
    if line_sep:
        options["lineSep"] = line_sep
    raw = reader.csv(path, **options)
    typed = {c: F.col(c).try_cast(t) for c, t in columns.items()}
    wrong = [(F.trim(F.col(c)) != "") & typed[c].isNull() for c, t in columns.items() if t != "string"]
    error = F.lit(False)
    for w in wrong:
        error = error | F.coalesce(w, F.lit(False))
    return raw.select(*[typed[c].alias(c) for c in columns], error.alias("error"))


def read_artifacts(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """time_key, kind, payload of the artifacts of all runs, or of some kinds only."""
    index = spark.read.schema("time_key string, sha256 string, kind string").parquet(f"{path}/index")
    payloads = spark.read.schema("sha256 string, payload string, kind string").parquet(f"{path}/payloads")
    if kinds:
        index, payloads = (t.filter(F.col("kind").isin(*kinds)) for t in (index, payloads))
    return index.join(payloads, ["kind", "sha256"]).select("time_key", "kind", "payload")


def load_texts_by_score(runs: DataFrame, artifacts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Texts of the runs whose coherence is above the threshold."""
    good = runs.filter(F.col("coherence") > threshold).select("time_key").distinct()
    return artifacts.filter(F.col("kind") == "text").join(good, "time_key", "left_semi").select(
        "time_key", F.col("payload").alias("text")
    )


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Size and modification time; the file content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def read_word_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of words -> one row per word."""
    lines = spark.read.text(path)
    return lines.select(F.explode(F.split(F.trim("value"), " +")).alias("word")).filter(F.col("word") != "")


def same_columns(frames: Sequence[DataFrame]) -> bool:
    """True when all frames have one schema."""
    return all(f.schema == frames[0].schema for f in frames)
