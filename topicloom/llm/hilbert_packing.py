"""Packing along a space-filling curve.

Each document's token counts, hashed to a fixed number of slots, are projected to a few dimensions and turned into a Hilbert key, so that
documents with like vocabulary lie near each other on the curve. Documents are range-sorted by key, and the token stream in that
order is cut every `length` tokens. Only the last sequence can be short, so padding is under one sequence in all.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running_total
from ..runtime import scratch_path
from .textbytes import mix, pieces

SEED = 3
SLOTS = 256
DIMENSIONS = 4
BITS = 10  # of each dimension in the key
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # of tokenizers whose pieces are known here


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `points` (rows x dimensions, whole numbers below 2^bits)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Ids:
    """Token ids of texts, as bytes of unsigned 32-bit numbers. Tokens never cross white space, and mostly not the edge of a run of letters either.

    A text of plain Latin letters is cut by the tokenizer's own pattern, and each distinct piece is put to its model once; other texts go
    through the whole tokenizer word by word. The stores are emptied when they have grown to `most` entries.
    """

    PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")  # letters that lower-case and compose one by one
    PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        spec = json.loads(whole.to_str())
        known = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"]}
        parts = {k: [x["type"] for x in (spec.get(k) or {}).get(f"{k}s", (spec.get(k) or {}).get("pretokenizers", []))] for k in known}
        self.simple = parts == known and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == PATTERN
        spelled, tokenize = byte_letters(), whole.model.tokenize

        def of_piece(piece: str) -> bytes:
            return array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(spelled))]).tobytes()

        def of_word(word: str) -> bytes:
            return array("I", whole.encode(word, add_special_tokens=False).ids).tobytes()

        self.pieces, self.words = Store(of_piece, most), Store(of_word, most)

    def __call__(self, text: str) -> bytes:
        if self.simple and "<|" not in text and self.PLAIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, self.PIECES.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, re.split(r"[\t-\r ]+", text)))


class Store(dict):
    """Results of `make` by key, for at most `most` keys at a time."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


def _keys(ids: list[np.ndarray], plane: np.ndarray) -> np.ndarray:
    """Hilbert keys of the documents of a piece."""
    slot = (mix(np.concatenate(ids).astype(np.uint64) + np.uint64(9)) % np.uint64(SLOTS)).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    counts = np.bincount(row * SLOTS + slot, minlength=len(ids) * SLOTS).reshape(len(ids), SLOTS)
    weights = np.sqrt(counts)
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)
    spread = np.tanh((weights - weights.mean(axis=1, keepdims=True)) @ plane)
    return hilbert_key(np.minimum(((spread + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def pack(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", length: int = 4096, end_id: int = 2
) -> DataFrame:
    """id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A document is its text's ids and then `end_id`; a null or empty text is `end_id` alone. `tokenizer` is a file that all
    executors have. It must not form tokens across white space. Repeated rows are packed as often as they occur; rows with a null id are
    packed like others. An empty table gives no pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = dict(source.dtypes)["id"]
    kind = np.dtype("<u4")

    def tokenise(batches):
        ids_of = Ids(tokenizer)
        last = np.array([end_id], dtype=kind).tobytes()
        plane = np.random.default_rng(SEED).normal(size=(SLOTS, DIMENSIONS)) * 1.2
        for batch in batches:
            for piece in pieces(batch, "text"):
                out = [ids_of(x or "") + last for x in piece.column("text").to_pylist()]
                ids = [np.frombuffer(x, dtype=kind) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(_keys(ids, plane)),
                        # Two bytes an id where all ids of the document fit.
                        pa.array([x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in ids], pa.binary()),
                    ],
                    ["id", "tokens", "curve", "ids"],
                )

    tokenised = source.mapInArrow(tokenise, f"id {id_type}, tokens long, curve long, ids binary")
    path = scratch_path(spark, "tokens")
    tokenised.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    written = spark.read.parquet(path)
    order = [F.col("curve"), F.col("row")]
    placed = running_total(written.select("row", "curve", "tokens"), order, weight="tokens", name="upto")
    placed = placed.select("row", (F.col("upto") - F.col("tokens")).alias("at"))

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            out: list[tuple] = []
            for item, tokens, data, at in zip(*(batch.column(x).to_pylist() for x in ("id", "tokens", "ids", "at"))):
                ids = np.frombuffer(data, dtype="<u2" if len(data) == 2 * tokens else kind).astype(kind)
                start = 0
                while start < tokens:
                    sequence, offset = divmod(at + start, length)
                    taken = min(length - offset, tokens - start)
                    raw = ids[start : start + taken].tobytes()
                    out.append((item, start, taken, raw, zlib.crc32(raw), tokens, sequence, offset))
                    start += taken
            kinds = [batch.schema.field(names.index("id")).type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            columns = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], CUT)

    CUT = ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"id {id_type}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    joined = written.select("row", "id", "tokens", "ids").join(placed, "row").select("id", "tokens", "ids", "at")
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_column)
