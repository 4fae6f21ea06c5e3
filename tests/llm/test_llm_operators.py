"""The operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from topicloom.llm.decontaminate import contaminated_words
from topicloom.llm.fuzzy_lines import edit_distance, fuzzy_lines
from topicloom.llm.hilbert_packing import hilbert_key, pack
from topicloom.llm.html_consensus import main_text
from topicloom.llm.jaccard_join import jaccard_classes
from topicloom.llm.line_quality import line_quality
from topicloom.llm.mil_quality import score, train
from topicloom.llm.pii_boosting import KINDS, base_spans, personal_data
from topicloom.llm.seed_extend import remove_repeats
from topicloom.llm.warc_derivatives import derivatives, responses_of_pages

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, id long, h long, n long, quality string"


def documents(spark, texts):
    """A table of texts with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in texts], DOCS)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


LONG = prose(1, 30_000)
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two"), (4, LONG), (5, LONG), (5, LONG), (6, "Été déjà vu\n" * 3), (7, "日本語 テスト")]


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def test_jaccard_components_by_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for family in range(25):
        base = prose(family, rng.choice([3, 5, 9, 14, 40, 120, 300]))
        texts += [edited(base, rng.random(), rng.choice([0, 0.005, 0.01, 0.03])) for _ in range(8)]
    rows = [*enumerate(texts), *[(1000 + i, t) for i, t in enumerate(["", "a", "a", None])]]
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(documents(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_on_odd_rows(spark):
    got = [(r.doc_id, r.component_id) for r in jaccard_classes(documents(spark, ODD)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (None, None), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7)], key=str)
    assert jaccard_classes(documents(spark, [])).count() == 0
    assert jaccard_classes(documents(spark, ODD), threshold=Fraction(1, 2)).count() == len(ODD)


def test_repeats_by_brute_force(spark):
    shared = prose(99, 60)
    rows = [*ODD, (10, prose(2, 50) + " " + shared + " " + prose(3, 40)), (11, shared + " " + prose(4, 33)), (12, prose(5, 35)), (13, prose(5, 34))]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((k, i))
    gone = {(k, p) for at in seen.values() if len(at) > 1 for k, i in at for p in range(i, i + 35)}
    want = [(i, len(w), sum((k, p) in gone for p in range(len(w))), " ".join(x for p, x in enumerate(w) if (k, p) not in gone)) for k, ((i, _), w) in enumerate(zip(rows, words))]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert remove_repeats(documents(spark, [])).count() == 0


def test_decontamination_on_odd_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, prose(7, 20)), (3, None), (4, ""), (None, "gamma"), (10, "BETA")], "item_id long, text string")
    rows = [*ODD, (20, "x Alpha, beta y"), (21, prose(8, 5) + " " + prose(7, 20) + " gamma"), (22, "alpha")]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contaminated_words(documents(spark, rows), items).collect()}
    assert got[20] == (4, 2, ["1", "10"])
    assert got[21] == (26, 21, ["2"])
    assert got[22] == (1, 0, []) and got[1] == (0, 0, []) and got[7][1] == 0
    assert contaminated_words(documents(spark, rows), items.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert contaminated_words(documents(spark, []), items).count() == 0


def test_line_quality_rules(spark):
    good = "\n".join(prose(s, 12) + "." for s in range(8))
    rows = [*ODD, (30, good), (31, good + "\nReleased under the MIT License."), (32, good.replace("w", "word").upper()), (33, "a | b | c | d\n" * 30), (34, "go on " * 60)]
    got = {r.doc_id: r.quality for r in line_quality(documents(spark, rows)).collect()}
    assert got[30].kept and got[30].clean_text == good
    assert got[31].kept and got[31].clean_text == good
    assert not got[32].kept and not got[32].base_failed
    assert not got[33].kept and got[34].base_failed and got[34].n_repeat_words == 120
    assert not got[1].kept and got[1].clean_text is None and got[2].n_words == 0
    assert line_quality(documents(spark, [])).count() == 0


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = [*ODD, *[(100 + i, prose(i, 40 * i + 1) + " Don't <|endoftext|> œuvre") for i in range(20)]]
    pieces = pack(documents(spark, rows), TOKENIZER, length=256).collect()
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows)
    open_docs, got = {}, []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):  # a document's pieces follow one another
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        open_docs.setdefault(p.doc_id, []).extend(ids)
        if len(open_docs[p.doc_id]) == p.doc_tokens:
            got.append(open_docs.pop(p.doc_id))
    assert sorted(got) == want and not open_docs
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert filled.get(p.sequence_id, 0) == p.offset
        filled[p.sequence_id] = p.offset + p.length
    assert sorted(filled.values())[1:] == [256] * (len(filled) - 1)
    assert pack(documents(spark, []), TOKENIZER).count() == 0


def test_hilbert_key_walks_by_single_steps():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = hilbert_key(points, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_edit_distance_by_brute_force():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(10))] for _ in "ab")
        most = rng.randrange(6)
        assert edit_distance(np.array(a, dtype=int), np.array(b, dtype=int), most) == min(full(a, b), most + 1)


def test_fuzzy_lines(spark):
    line = prose(1, 40)
    near = line.replace(line.split()[7], "other", 1)
    rows = [(1, line + "\nshort one\n" + prose(2, 30)), (2, "short one\n" + line.upper()), (3, near), (4, prose(3, 40)), (5, None), (6, ""), (7, prose(4, 9000)), (None, prose(5, 10))]
    got = {r.doc_id: r for r in fuzzy_lines(documents(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].text == "short one" and got[2].n_removed == 1
    assert got[4].n_removed == 0 and got[5].text is None and got[5].n_lines == 0 and got[6].text == ""
    assert got[7].text == rows[6][1] and got[None].n_removed == 0 and got[1].quality == "x"
    assert fuzzy_lines(documents(spark, [])).count() == 0
    assert fuzzy_lines(documents(spark, ODD)).count() == len(ODD)


def test_base_spans_by_brute_force():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a.@-+1290 (é") for _ in range(rng.randrange(30)))
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert base_spans(text)["email"] == want


def test_personal_data(spark):
    rows = [*ODD, *[(50 + i, f"Call +1 (310) 555-{4000 + i} or ana{i}@mail.example.com, host 10.0.{i}.7 not 10.0.{i}.777, card 4111 1111 1111 1111 é") for i in range(30)]]
    got = {r.doc_id: r for r in personal_data(documents(spark, rows)).collect()}
    assert [KINDS[s.kind] for s in got[50].base] == ["email", "ip", "card", "phone"]
    assert {tuple(s) for s in got[50].base} <= {tuple(s) for s in got[50].spans}
    assert got[1].spans == [] and got[2].base == []
    assert personal_data(documents(spark, [])).count() == 0


def test_attention_learns_and_scores_odd_rows(spark):
    good = [(i, prose(i, 150)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}###" for w in prose(i, 150).split())) for i in range(60)]
    docs = documents(spark, [*good, *bad, *[(200, None), (201, ""), (202, LONG)]])
    labels = spark.createDataFrame([*[(i, 1) for i, _ in good[:40]], *[(i, 0) for i, _ in bad[:40]], (None, 1), (5, None), (9999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in score(docs, train(docs, labels, "doc_id", "text", "quality")).collect()}
    assert all(got[i] > 0.5 for i, _ in good[40:]) and all(got[i] < 0.5 for i, _ in bad[40:])
    assert all(0 <= s <= 1 for s in got.values()) and abs(got[200] - got[201]) < 1e-9
    assert train(docs, labels.limit(0), "doc_id", "text", "quality") is None
    assert {r.score for r in score(docs, None).collect()} == {0.5}


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav>Home</nav><div class="ad">Buy, buy.</div>
<div class="story s{n}"><h1>A &amp; B</h1><p>First &eacute;  text,
with more.<p>Second <b>text</b>, here.<form>mail</form></div><div class="comments"><p>Nice, very nice, indeed.</p></div><footer>&copy;</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(5)] + [(7, None, None), (8, "x", ""), (9, "https://h.example/x", "plain <b>words</b>")]
    pages = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in main_text(pages).collect()}
    for i in range(5):
        assert got[i].text == "A & B\nFirst é text, with more.\nSecond text, here."
        assert got[i].path == "/html/body/div.s#.story" and got[i].n_chars == len(got[i].text)
    assert got[7].text == "" and got[8].n_chars == 0 and got[9].text == "plain words"
    assert main_text(pages.limit(0)).count() == 0


def test_warc_derivatives(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", PAGE), (2, None, None), (1, "https://a.example/", PAGE)], "page_id long, url string, html string")
    responses = responses_of_pages(pages, "2024-01-01T00:00:00Z")
    got = derivatives(responses).collect()
    assert len(got) == 6 and {r.type for r in got} == {"conversion", "metadata"}
    source = {r.source_id: r.record_id for r in responses.collect()}
    by_id = {r.record_id: r for r in got}
    for r in got:
        headers = {h.name: h.value for h in r.headers}
        assert r.refers_to == source[r.source_id] == headers["WARC-Refers-To"]
        assert by_id[r.concurrent_to].concurrent_to == r.record_id
        assert r.content_length == len(r.block.encode()) == int(headers["Content-Length"])
    assert "http-content-type: text/html" in next(r.block for r in got if r.type == "metadata")
    assert derivatives(responses.limit(0)).count() == 0


def test_pipeline_stages_keep_the_columns(spark, sf):
    docs = documents_table = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), documents_table.schema)
        assert docs.columns == documents_table.columns, name
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, sf).collect()} == ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents_table.limit(0), sf).count() == 0


@pytest.mark.parametrize("number", range(1, 11))
def test_one_query_for_each_operator(number):
    assert len([q for q in entry.queries() if q.startswith(f"op{number}_")]) == 1


def test_repeated_and_long_labelled_documents_are_bounded(spark, monkeypatch):
    from topicloom.llm import mil_quality

    monkeypatch.setattr(mil_quality, "TRAINING_DOCS", 20)
    taken = []
    monkeypatch.setattr(mil_quality.AttentionModel, "fit", lambda self, bags, labels, seed: taken.append([len(b) for b in bags]))
    texts = [(1, LONG)] * 30 + [(2, prose(i, 100)) for i in range(40)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    train(documents(spark, texts), labels, "doc_id", "text", "quality")
    assert len(taken[0]) == 20 and max(taken[0]) <= mil_quality.TRAINING_PASSAGES
