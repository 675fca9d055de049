"""Licence scans, periodic runs and ranked search against plain Python versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import licenses, periodic_runs, search
from tidemark.llm.common import documents, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    frame = pd.read_parquet(f"{SF}/documents.parquet")
    return list(zip(frame["doc_id"].tolist(), frame["text"].tolist()))


def terms(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# ---------------------------------------------------------------- licences


def plain_license(text):
    w = terms(text)
    places = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    places.sort()
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({label for _, label in places}))


def test_licences_equal_plain_search(spark, texts):
    rows = texts + [(10**6 + k, t) for k, t in enumerate(["MIT Licenseé", "mit\x00LICENSE cc-by cc by", "apache license " * 500, "gnu general gnu general public license apache", "x mit", "license", "cc  \x7fby"])]
    got = licenses.license_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got}
    assert found == {i: plain_license(t) for i, t in rows} and sum(r["n_base"] > 0 for r in got) > 5
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def test_automaton_equals_all_factors():
    rnd = random.Random(2)
    for _ in range(300):
        k = rnd.choice([2, 3, 5])
        templates = [[b"%d" % rnd.randrange(k) for _ in range(rnd.randint(1, 7))] for _ in range(rnd.randint(1, 5))]
        automaton = licenses.build_automaton(templates)
        factors = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i, len(t) + 1)}
        text = [b"%d" % rnd.randrange(k + 1) for _ in range(20)]
        numbers = [automaton.words.get(w, 0) for w in text]
        for i, (state, size) in enumerate(licenses.matching_statistics(automaton, numbers)):
            assert size == max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in factors)
            match = text[i + 1 - size : i + 1]
            assert not size or automaton.ends[state] == {t: p + size for t, words in enumerate(templates) for p in reversed(range(len(words) - size + 1)) if words[p : p + size] == match}
        whole = licenses.scan_words(automaton, np.array(numbers), np.array([0, 20]), 2, 3).get(0, ([], []))[0]
        assert sorted(whole) == sorted((t, p) for t, words in enumerate(templates) for p in range(21 - len(words)) if text[p : p + len(words)] == words)


def test_notices_with_edits_are_covered_spans(spark):
    notice = dict(licenses.TEMPLATES)["isc"]
    words = notice.split()
    edited = " ".join([*words[:9], "unlike", *words[10:20], "really", "so", *words[20:]])
    filler = "zzz " * 300
    rows = [(1, f"{filler}{notice.upper()} {filler}"), (2, filler + edited), (3, " ".join(words[:9])), (4, f"{filler}{filler.join(words)}"), (5, f"{notice}\n{notice}")]
    got = {r["doc_id"]: r["spans"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(terms(notice))
    assert [(s["label"], s["first_word"], s["last_word"], s["covered"], s["share"]) for s in got[1]] == [("isc", 300, 300 + n - 1, n, 1.0)]
    assert [(s["label"], s["covered"]) for s in got[2]] == [("isc", n - 1)] and got[2][0]["last_word"] == 300 + n + 1
    assert got[3] == [] and got[4] == [] and [s["first_word"] for s in got[5]] == [0, n]


# ---------------------------------------------------------------- runs


def plain_runs(w):
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                found.append((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w and doc_id is not None:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_all_periods():
    rnd = random.Random(1)
    for _ in range(400):
        some = []
        for _ in range(rnd.randint(1, 5)):
            k = rnd.choice([1, 2, 3, 10])
            d = [rnd.randrange(k) for _ in range(rnd.choice([0, 1, 5, 6, 7, 40, 80]))]
            if rnd.random() < 0.5:
                p = [rnd.randrange(4) for _ in range(rnd.randint(1, 9))]
                at = rnd.randint(0, len(d))
                d[at:at] = p * rnd.randint(3, 7) + p[: rnd.randint(0, len(p))]
            some.append(d)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in some])]).astype(np.int64)
        got = periodic_runs.find_runs(np.array([x for d in some for x in d], np.int64), bounds)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, d in enumerate(some) for r in plain_runs(d)]


def test_run_digests_equal_plain_version(spark, texts):
    short = [(i, t) for i, t in texts if len(t or "") < 6000]
    made = [(10**6 + k, t) for k, t in enumerate(["a b " * 9 + "c c c c c c", "a a a a a", "x " * 5000, "\x0b".join("ab" * 8), "é é " * 7, "", " \n", "a b c d " * 4 + "a b c"])]
    rows = short + made + [(None, "k " * 8), (3, None), (3, None)]
    got = periodic_runs.run_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    listed = sorted(map(repr, ((r["doc_id"], tuple(r)[1:]) for r in got)))
    assert listed == sorted(map(repr, ((i, plain_digest(i, t)) for i, t in rows)))
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_long_texts_of_one_word_and_of_one_stretch():
    for period in (1, 7, 1000):
        codes = np.arange(300_000, dtype=np.int64) % period
        assert periodic_runs.find_runs(codes, np.array([0, len(codes)])).tolist() == [[0, 0, 300_000, period]]


# ---------------------------------------------------------------- search


def plain_search(docs, items, k=20):
    split = lambda t: terms(t, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    rows = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        rows += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "The cat sat, the CAT"), (1, "other words"), (2, ""), (3, None), (4, "nowhere_to be"), (None, "cat"), (2, "cat"), (2, "cat")]


def test_search_equals_all_scores(spark):
    rnd = random.Random(3)
    vocabulary = ["the", "cat", "Sat", "dog", "other", "words", "é", "x9", "be"]
    docs = [(i if i % 13 else None, " ".join(rnd.choices(vocabulary, [9, 2, 2, 3, 1, 1, 1, 1, 0.1], k=rnd.choice([0, 1, 3, 30])))) for i in range(300)] + [(5, "cat"), (5, "cat"), (7, None)]
    queries = spark.createDataFrame(ITEMS, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(100)  # so many segments that floors are used
    assert listed(search.search_documents(frame, queries, 7)) == plain_search(docs, ITEMS, 7)
    assert search.search_documents(frame.limit(0), queries).count() == 0 and search.search_documents(frame, queries.limit(0)).count() == 0


def test_blocks_of_queries_on_a_whole_index(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 2)
    docs = [(k, f"cat the {'other ' * (k % 5)} sat words") for k in range(50)]
    index = written(search.index_documents(spark.createDataFrame(docs, "doc_id long, text string")), "index")
    assert listed(search.search_index(index, spark.createDataFrame(ITEMS, "item_id long, text string"), 5)) == plain_search(docs, ITEMS, 5)


def test_few_accumulators_and_whole_scores():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        n, k = 60, 5
        impacts = []
        for df in sorted(rnd.integers(1, n, 6)):
            docs = np.sort(rnd.choice(n, df, replace=False))
            adds = rnd.integers(1, 2000 // df + 2, df)
            impacts.append((docs, adds, int(adds.max())))
        repeats = rnd.integers(1, 3, 6)
        whole = np.zeros(n, np.int64)
        for (docs, adds, _), r in zip(impacts, repeats):
            whole[docs] += adds * r
        kth = np.sort(whole)[-k]
        found, scores = search.best_of_segment(impacts, repeats, n, k, 0)
        assert dict(zip(found.tolist(), scores.tolist())) == {i: s for i, s in enumerate(whole.tolist()) if s >= max(1, kth)}
        found, _ = search.best_of_segment(impacts, repeats, n, k, int(kth) + 1)
        assert set(found.tolist()) == {i for i, s in enumerate(whole.tolist()) if s > kth}


def test_search_equals_its_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = search.search_documents(documents(spark, SF), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert listed(got) == sorted((tuple(r) for r in duck.sql(f"select item_id, rank, doc_id, score from ({search.SQL})").fetchall()), key=repr)


# ---------------------------------------------------------------- all three


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "cc by x", "a", 2, [3]), (1, "cc by x", "a", 2, [3])], "doc_id int, text string, labels string, n_words int, runs array<int>")
    assert [r["labels"] for r in licenses.license_rows(docs).collect()] == ["cc-by"] * 2
    assert [r["n_runs"] for r in periodic_runs.run_digests(docs).collect()] == [0, 0]
    assert [(r["doc_id"], r["rank"]) for r in search.search_documents(docs, spark.createDataFrame([(1, "x")], "item_id int, text string")).collect()] == [(1, 1), (1, 2)]  # a term in all of two documents weighs 182
    empty = docs.limit(0)
    assert licenses.license_rows(empty).count() == 0 and periodic_runs.run_digests(empty).count() == 0
