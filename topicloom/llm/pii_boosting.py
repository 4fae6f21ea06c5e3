"""Personal data by candidate gradient boosting.

Strict patterns give the base spans. Loose generators propose further, overlapping candidates of the same kinds. Each candidate has format and
context features; boosted trees are trained on a bounded sample of candidates, those that the strict rules accept against
those that they reject, without the features that only repeat the strict rule. A threshold for each kind is calibrated on held-out candidates
for PRECISION. A candidate above it that overlaps no base span is added; of overlapping ones the most probable.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .textbytes import pieces

KINDS = ("email", "ip", "card", "phone")
TRAINING_CANDIDATES = 20_000  # bound of the sample: candidates with the smallest hash
TREES, DEPTH, SEED = 12, 4, 5
PRECISION = 0.98

# Fixed patterns of the base rules.
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # four numbers in a row of it are an address
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# Loose generators.
LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:\.|\[\.\]|, ?)[0-9]{1,4}){3}(?![0-9.])|(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?:\+ ?|\b00|\()?[0-9][0-9 ()./-]{5,22}[0-9]"),
}
SIGN = re.compile(r"@|\(at\)|\[at\]")
LOOSE_HOST = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
CUES = {
    "email": re.compile(r"mail|contact|write|@", re.I),
    "ip": re.compile(r"\bip\b|host|address|server|client|login", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|cvv|expir", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|cell|\+", re.I),
}
CONTEXT = 24  # characters on each side of a candidate
CUE = 13  # place of the cue among the features


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def before(text: str, end: int, least: int) -> int:
    """Where the local part of an address begins that ends at `end`, `least` at the earliest."""
    while end > least and (text[end - 1] in "._%+-" or (text[end - 1].isascii() and text[end - 1].isalnum())):
        end -= 1
    return end


def emails(text: str) -> list[tuple[int, int]]:
    """Spans that the pattern of an address finds from left to right, by going from one @ to the next."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        low = before(text, at, done)
        host = HOST.match(text, at + 1) if low < at else None
        if host:
            out.append((low, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Spans that the pattern of an address of four numbers finds from left to right: each four of a row joined by dots."""
    out = []
    for row in DOTTED.finditer(text):
        if row.group().count(".") >= 3:
            ends = [row.start() - 1, *[row.start() + m.start() for m in re.finditer(r"\.", row.group())], row.end()]
            out += [(ends[i] + 1, ends[i + 4]) for i in range(0, len(ends) - 4, 4)]
    return out


def valid(kind: str, found: str) -> bool:
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "ip":
        return all(int(p) <= 255 if len(p) < 10 else not p.lstrip("0")[3:] and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the strict rules by kind; matches that fail are dropped."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        out["ip"] = [span for span in addresses(text) if valid("ip", text[span[0] : span[1]])]
        for kind, pattern in (("card", CARD), ("phone", PHONE)):
            if kind != "phone" or "+" in text:
                out[kind] = [m.span() for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of the loose generators, by kind and start; each generator's spans are apart from one another."""
    out, done = [], 0
    for sign in SIGN.finditer(text):
        low = before(text, sign.start() - (text[sign.start() - 1 : sign.start()] == " "), done) if sign.start() else 0
        tail = LOOSE_HOST.match(text, sign.end()) if low < sign.start() and text[low] != " " else None
        if tail:
            out.append(("email", low, tail.end()))
            done = tail.end()
    for kind, pattern in LOOSE.items():
        if DIGIT.search(text) or (kind == "ip" and ":" in text):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def rewritten(kind: str, found: str, way: int) -> str:
    """A strict span in a form that the strict rule does not know; `way` picks one."""
    if kind == "email":
        at, dot = (("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "))[way % 3]
        local, host = found.rsplit("@", 1)
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return found.replace(".", ("[.]", ", ")[way % 2])
    digits = [c for c in found if c in "0123456789"]
    if kind == "card":
        sep = "./_"[way % 3]
        return sep.join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4))
    return ("00" if way % 2 else "") + found[1:]


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the candidate and what stands around it."""
    found = text[start:end]
    digits = "".join(c for c in found if c in "0123456789")
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    parts = re.findall(r"[0-9]+", found)
    return [
        float(KINDS.index(kind)), float(len(found)), float(len(digits)), float(len(parts)), float(max(map(len, parts), default=0)),
        float(min(map(len, parts), default=0)), float(max((int(p[:9]) for p in parts), default=0) > 255), float(luhn(digits)) if digits else 0.0,
        float(found.count(".")), float(found.count(" ")), float(found.count("-")), float("(" in found), float(found.startswith(("+", "00"))),
        float(bool(CUES[kind].search(before))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
    ]


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, base, spans: one row per row of `docs`; both are lists of (kind, start, end) by kind and start, in code points, end exclusive.

    `base` has the strict spans, `spans` those and the added ones. Null and empty texts have none. Rows with equal id and text are
    treated alike; null ids are allowed. If all sampled candidates are of one class, nothing is added. Added spans do not overlap: the likelier stays, of equals the first. Other columns are not read.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("h", F.xxhash64("id", "text"))
    id_type = dict(source.dtypes)["id"]
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    loose = pa.struct([("made", pa.bool_()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("x", pa.list_(pa.float64()))])

    def scan(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                base, extra = [], []
                for text in piece.column("text").to_pylist():
                    strict = base_spans(text or "")
                    spans = [(KINDS.index(k), a, b) for k in KINDS for a, b in strict[k]]
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    found = []
                    for kind, a, b in candidates(text or ""):
                        if all(b <= c or d <= a for _, c, d in spans):
                            found.append({"made": False, "kind": KINDS.index(kind), "start": a, "end": b, "x": features(kind, text, a, b)})
                    for k, a, b in spans:
                        if KINDS[k] != "ip" or b - a < 40:
                            new = rewritten(KINDS[k], text[a:b], a)
                            around = text[max(0, a - CONTEXT) : a] + new + text[b : b + CONTEXT]
                            start = min(a, CONTEXT)
                            found.append({"made": True, "kind": k, "start": a, "end": b, "x": features(KINDS[k], around, start, start + len(new))})
                    extra.append(found)
                columns = [piece.column("id"), piece.column("h"), pa.array(base, pa.list_(span)), pa.array(extra, pa.list_(loose))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "base", "loose"])

    kinds = "struct<kind:int,start:long,end:long>"
    schema = f"id {id_type}, h long, base array<{kinds}>, loose array<struct<made:boolean,kind:int,start:long,end:long,x:array<double>>>"
    rows = materialize(source.select("id", "h", "text").mapInArrow(scan, schema), "spans")
    every = rows.select("h", F.explode("loose").alias("c")).select("h", "c.*")
    added = _accepted(every)
    if added is None:
        return rows.select(F.col("id").alias(id_column), "base", F.col("base").alias("spans"))
    per_row = added.groupBy("h").agg(F.collect_set(F.struct("p", "kind", "start", "end")).alias("more"))

    def settle(batches):
        for batch in batches:
            out = []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist()):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                fresh: list[tuple[int, int, int]] = []
                for s in sorted(more or [], key=lambda s: (-s["p"], s["start"], s["end"], s["kind"])):
                    if all(s["end"] <= a or b <= s["start"] for _, a, b in fresh):
                        fresh.append((s["kind"], s["start"], s["end"]))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans + fresh)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("base"), pa.array(out, pa.list_(span))], ["id", "base", "spans"])

    joined = rows.drop("loose").join(per_row, "h", "left").select("id", "base", "more")
    return joined.mapInArrow(settle, f"id {id_type}, base array<{kinds}>, spans array<{kinds}>").withColumnRenamed("id", id_column)


def _accepted(every: DataFrame) -> DataFrame | None:
    """Candidates apart from base spans that the trees accept: h, kind, start, end, p.

    The trees learn from strict spans rewritten without their format, in their own context, against candidates with no cue before them; other
    candidates have no label. They are fitted on a bounded sample of two thirds of the documents. Thresholds are calibrated on every
    labelled candidate of the other third, as counts by kind and score.
    """
    cue = F.get("x", F.lit(CUE)) > 0
    label = F.when(F.col("made"), 1.0).when(~cue, 0.0)
    every = every.withColumn("label", label).withColumn("features", array_to_vector("x"))
    held = F.pmod(F.xxhash64("h"), F.lit(3)) == 0
    order = F.xxhash64("h", "kind", "start", "end")
    known = every.filter("label is not null")
    sample = known.filter(~held).orderBy(order, "h", "start", "end", "kind").limit(TRAINING_CANDIDATES).select("label", "features")
    sample = materialize(sample.coalesce(1), "sample")
    if sample.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3).fit(sample)
    sure = vector_to_array(F.col("probability"))[1]
    bins = model.transform(known.filter(held)).select("kind", "label", F.floor(sure * 100).alias("bin"))
    counts = bins.groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()  # 4 x 101 rows at most
    limits = {}
    for kind in range(len(KINDS)):
        n = good = 0
        for row in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.bin):
            n, good = n + row.n, good + row.good
            if good < PRECISION * n:
                break
            limits[kind] = row.bin / 100
    if not limits:
        return None
    limit = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)])[F.col("kind")]
    scored = model.transform(every.filter("not made")).select("h", "kind", "start", "end", sure.alias("p"))
    return scored.filter(limit.isNotNull() & (F.col("p") >= F.greatest(limit, F.lit(0.5))))
