"""Every opN query and the pipeline on the smallest tables: their columns, and rows that hang together."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

COLUMNS = {
    1: "doc_id n_words n_hit n_items items_sha256 contaminated",
    2: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    3: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    4: "doc_id n_lines n_removed text",
    5: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    6: "page_id record_id refers_to block",
    7: "doc_id n_words n_removed kept_sha256",
    8: "doc_id n_shingles component_id",
    9: "doc_id held_out score predicted",
    10: "page_id url text n_chars",
    11: "page_id host path rule verdict",
    12: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    13: "word form root n n_near form_n",
}


def query(number):
    return next(f for name, f in entry.queries().items() if name.startswith(f"op{number}_"))


@pytest.mark.parametrize("number", COLUMNS)
def test_query_has_its_columns_and_rows(spark, sf, number):
    frame = query(number)(spark, sf)
    assert set(COLUMNS[number].split()) <= set(frame.columns)
    rows = frame.count()
    source = {6: "pages", 10: "pages", 11: "pages", 13: None}.get(number, "documents")
    if source and number != 3:
        n = spark.read.parquet(f"{sf}/{source}.parquet").count()
        assert rows == (2 * n if number == 6 else n)
    assert rows > 0


def check_pieces(pieces, texts):
    """Pieces give every document's tokens once, in sequences without gaps."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    assert set(of_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(of_doc[doc_id], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for rows in of_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def test_packing_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    check_pieces(query(3)(spark, sf).collect(), texts)


def test_pipeline_runs_its_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    check_pieces(corpus_pipeline.run(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()})
