"""Vectors of tokens: blocks give what a join of single tokens gives, and no vector is shuffled to its document."""

import pytest
from pyspark.sql import functions as F

from topicloom.operators import dictionary as D
from topicloom.plans.text_queries import checksum, column_checksum

DOCS = [(1, ["a", "b", "a", "z"]), (None, ["b", None, "c"]), (2, []), (3, None), (1, ["c", "b"]), (None, ["a"]), (4, ["n"] * 9), (5, ["two", "a"])]
VECTORS = [("a", [1.0, 2.0]), ("b", [0.5, -4.0]), ("c", [3.0, 0.25]), ("two", [7.0, 8.0]), ("two", [6.0, 9.0]), ("n", None), ("unused", [1.0, 1.0])]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, tokens array<string>"), spark.createDataFrame(VECTORS, "token string, vector array<float>")


def expected_rows():
    out = []
    for key, words in DOCS:
        for pos, word in enumerate(words or []):
            if word is not None:
                for vector in [v for t, v in VECTORS if t == word] or [None]:
                    out.append((key, pos, word, vector is not None, vector or [0.0, 0.0]))
    return out


@pytest.mark.parametrize("block_tokens", [1, 3, 1 << 18])
def test_tokens_meet_their_vectors_by_blocks(tables, block_tokens):
    rows = D.embed_tokens(*tables, 2, block_tokens=block_tokens)
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, expected_rows()))


@pytest.mark.parametrize("block_tokens", [1, 3, 1 << 18])
def test_vectors_are_stacked_where_they_stand(tables, block_tokens):
    stacked = D.stack_vectors(D.embed_tokens(*tables, 2, block_tokens=block_tokens), together=True)
    want = {}
    for key, pos, _, _, vector in expected_rows():
        want.setdefault(key, []).append((pos, vector))
    got = [(r.doc_id, r.vectors) for r in stacked.collect()]
    assert len(got) == len(want)
    assert dict(got) == {k: [v for _, v in sorted(p)] for k, p in want.items()}
    shuffled = [line for line in stacked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert not shuffled, "vectors must not be grouped by a shuffle"


def test_long_documents_leave_in_parts(spark):
    words = [f"w{i % 7}" for i in range(3 * D.OUT_TOKENS + 5)]
    docs = spark.createDataFrame([(i, words) for i in range(3)], "doc_id bigint, tokens array<string>")
    vectors = spark.createDataFrame([(f"w{i}", [float(i)]) for i in range(6)], "token string, vector array<float>")
    stacked = D.stack_vectors(D.embed_tokens(docs, vectors, 1), together=True).collect()
    flat = [float(i % 7 % 6) if i % 7 < 6 else 0.0 for i in range(len(words))]
    assert sorted(r.doc_id for r in stacked) == [0, 1, 2] and all([v[0] for v in r.vectors] == flat for r in stacked)


def test_column_checksum_is_the_checksum(spark):
    rows = spark.createDataFrame([([1.0, 2.5, -3.0],), ([],), (None,), ([1.0, None],), ([0.1] * 64,)], "vector array<double>")
    got = rows.select(checksum(F.col("vector")).alias("a"), column_checksum("vector").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
