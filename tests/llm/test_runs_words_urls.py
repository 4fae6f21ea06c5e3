"""Operators 5 (counts), 11, 12 and 13 against brute force, and on nulls, empty and long inputs, repeats, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from topicloom.llm import spelling_variants as variants_module
from topicloom.llm.periodic_runs import COVER, DIFFERENCES, Extensions, find_runs, periodic_runs, synchronised
from topicloom.llm.pii_boosting import KINDS, base_spans
from topicloom.llm.spelling_variants import spelling_variants
from topicloom.llm.url_filter import threshold, url_filter

DOCS = "doc_id long, text string, id long, row long, runs string, judged string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in texts], DOCS)


# Periodic runs


def runs_by_hand(words, exponent, least):
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                found.setdefault((i, length), p)
            i = max(j, i + 1)
    return sorted((s, m, p) for (s, m), p in found.items())


def test_any_two_residues_meet():
    after = synchronised()
    for a in range(COVER):
        for b in range(COVER):
            steps = after[a, b]
            assert steps < COVER and (a + steps) % COVER in DIFFERENCES and (b + steps) % COVER in DIFFERENCES


def test_extensions_equal_direct_comparison():
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 30):
        symbols = np.concatenate([rng.integers(0, kinds, 300), [1000]])
        lce = Extensions(symbols, np.zeros(301, dtype=np.int64))
        one, two = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
        one, two = one[one != two], two[one != two]
        for i, j, got in zip(one.tolist(), two.tolist(), lce(one, two).tolist()):
            k = 0
            while max(i, j) + k < 301 and symbols[i + k] == symbols[j + k]:
                k += 1
            assert got == k


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 10)])
def test_runs_by_brute_force(exponent, least):
    rng = random.Random(exponent)
    for _ in range(80):
        docs = []
        for _ in range(rng.randrange(1, 7)):
            n, kinds = rng.choice([0, 1, 5, 6, 40, 150, 500]), rng.choice([1, 2, 3, 60])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n > 20 and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            docs.append(words)
        docs.append(docs[0])
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        flat = np.array([w for d in docs for w in d], dtype=np.int64)
        want = [(r, *t) for r, d in enumerate(docs) for t in runs_by_hand(d, exponent, least)]
        assert [tuple(c) for c in find_runs(flat, first, exponent, least).T.tolist()] == want


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (None, "a a a a a a"), (4, "x a b a b a b a b y"), (4, "x a b a b a b a b y"), (5, "a a a a a"), (6, long), (7, "é\té\né é\x0bé é z")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in periodic_runs(documents(spark, texts)).collect())
    assert got == [
        (-1, 6, [(0, 6, 1)], "a"),
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 10, [(1, 8, 2)], "x a b y"),
        (4, 10, [(1, 8, 2)], "x a b y"),
        (5, 5, [], "a a a a a"),
        (6, 60_000, [(0, 60_000, 700)], " ".join(f"w{i}" for i in range(700))),
        (7, 7, [(0, 6, 1)], "é z"),
    ]
    assert periodic_runs(documents(spark, texts).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(documents(spark, texts), exponent=1)


# Spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(counts, times=10):
    rows = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        rows[w] = (form, n, len(others), counts[form] if form else None)
    out = []
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, n_near, form_n))
    return sorted(out)


def some_words(seed, stems, shortest):
    rng = random.Random(seed)
    counts = Counter()
    for _ in range(stems):
        word = "".join(rng.choice("abcé") for _ in range(rng.randrange(shortest, 14)))
        counts[word] += rng.choice([2, 30, 500, 7000])
        for _ in range(4):
            i, kind = rng.randrange(len(word) + 1), rng.randrange(3)
            other = word[:i] + ("" if kind == 0 else rng.choice("abcdé")) + word[i + (kind < 2) :]
            if len(other) >= shortest:
                counts[other] += rng.choice([2, 3, 40])
    return counts


@pytest.mark.parametrize("most_in_a_list", [64, 1])
@pytest.mark.parametrize("shortest", [7, 1])
def test_variants_by_brute_force(spark, monkeypatch, most_in_a_list, shortest):
    monkeypatch.setattr(variants_module, "LIST", most_in_a_list)
    counts = some_words(shortest, 150, shortest)
    table = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, root string, key long")
    assert sorted(map(tuple, spelling_variants(table).collect())) == variants_by_hand(counts)


def test_variants_of_odd_words(spark):
    long = "ab" * 3000
    rows = [("", 5), ("a", 50), ("a", 10), (None, 3), ("b", None), (long, 2), (long[:-1] + "c", 20), ("aaaaaaaaaa", 2), ("aaaaaaaaa", 2), ("日本語日本語日本", 9), ("日本語日本語日木", 1)]
    counts = {"": 5, "a": 60, long: 2, long[:-1] + "c": 20, "aaaaaaaaaa": 2, "aaaaaaaaa": 2, "日本語日本語日本": 9, "日本語日本語日木": 1}
    table = spark.createDataFrame(rows, "word string, n long")
    assert sorted(map(tuple, spelling_variants(table).collect())) == variants_by_hand(counts)
    assert spelling_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(table, times=1)


# URLs

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PAGES = "page_id long, url string, judged string, gram string, host string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "old", "g", "h") for i, u in enumerate(urls)], PAGES)


def test_rules_hosts_and_paths(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "http://example.org/en/15", "x://b.org", "x://notorg/", "ftp://a.com/fr/de/?://q", "http://EXAMPLE.org", "http://org/", "a://b://c.com/de/"]
    got = [tuple(r.judged)[:3] for r in url_filter(pages(spark, urls), RULES).orderBy("page_id").collect()]
    assert got == [
        ("", "", None),
        ("", "", None),
        ("", "", None),
        ("a.example.org", "/es/x", "example.org/es/"),
        ("example.org", "/en/15", "example.org/en/1"),
        ("b.org", "", None),
        ("notorg", "/", None),
        ("a.com", "/fr/de/", "com/fr/"),
        ("example.org", "", None),
        ("org", "/", "org/"),
        ("b:", "//c.com/de/", None),
    ]
    frame = url_filter(pages(spark, urls), RULES)
    assert frame.columns == ["page_id", "url", "gram", "host", "judged"]
    assert {r.judged.verdict for r in frame.collect()} <= {"allow", "block"}
    assert url_filter(pages(spark, urls).limit(0), RULES).count() == 0


def test_models_tell_unruled_urls_apart(spark):
    rng = random.Random(3)
    good, bad = ["garden", "library", "recipes", "history"], ["casino", "xxx-win", "cheap-pills", "jackpot"]

    def url(names, top):
        return f"http://{rng.choice(names)}{rng.randrange(99)}.{top}/{rng.choice(names)}/{rng.randrange(999)}"

    labelled = [url(good, "org") for _ in range(300)] + [url(bad, "bad") for _ in range(300)]
    open_urls = [url(good, "net") for _ in range(100)] + [url(bad, "net") for _ in range(100)]
    long = "http://" + "garden" * 3000 + ".net/"
    rows = url_filter(pages(spark, labelled + open_urls + [long]), [("allow", "org", "/"), ("block", "bad", "/")]).orderBy("page_id").collect()
    verdicts = [r.judged.verdict for r in rows]
    assert verdicts[:600] == ["allow"] * 300 + ["block"] * 300
    assert sum(v == w for v, w in zip(verdicts[600:800], ["allow"] * 100 + ["block"] * 100)) >= 190
    assert verdicts[800] == "allow"
    assert all((r.judged.score_bin is None) == (i < 600) for i, r in enumerate(rows))


def test_threshold(spark):
    def of(rows):
        return threshold(spark.createDataFrame(rows, "bin long, yes long, no long"))

    assert of([(-3, 0, 9), (-2, 1, 1), (2, 8, 0)]) == -2
    assert of([(-3, 0, 9), (5, 9, 0)]) == 1
    assert of([(4, 9, 0)]) == of([]) == 0


# Personal data: the query's columns


def test_counts_of_personal_data(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = entry.queries()["op5_pii_boosting"](spark, sf).collect()
    assert len(rows) == len(texts)
    total = Counter()
    for r in rows:
        count = Counter({k: len(spans) for k, spans in base_spans(texts[r.doc_id]).items()})
        assert [r[f"n_{name}"] for name in KINDS] == [count[k] for k in KINDS]
        total += count
    assert total


@pytest.mark.parametrize("number", [11, 12, 13])
def test_one_query_each_with_sql(number):
    names = [q for q in entry.queries() if q.startswith(f"op{number}_")]
    assert len(names) == 1 and names[0] in entry.oracle_sql()


def test_planted_runs_follow_the_rule(spark):
    from topicloom.llm.queries import _with_planted_runs

    rng = random.Random(2)
    docs = {i: " ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 2, 7, 50]))) for i in range(300)}
    for r in _with_planted_runs(documents(spark, docs.items())).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        assert (r.text or "").split() == words
