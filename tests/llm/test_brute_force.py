"""Operators against plain Python versions on small tables with planted cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontamination, jaccard_join, languages, mixing, pii, quality, repeats, token_counts, token_ids, toxicity
from tidemark.llm.common import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    frame = pd.read_parquet(f"{SF}/documents.parquet")
    return list(zip(frame["doc_id"].tolist(), frame["text"].tolist()))


def same_as_sql(df, sql, tables=("documents",)):
    duck = duckdb.connect()
    for t in tables:
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = df.toPandas(), duck.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    ours, theirs = (f[columns].sort_values("doc_id").reset_index(drop=True) for f in (ours, theirs))
    assert all((ours[c] == theirs[c]).all() for c in columns)


def test_quality_equals_its_sql(spark):
    same_as_sql(quality.quality(documents(spark, SF)), quality.SQL)


def test_quality_of_repeated_rows_equals_its_sql(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, "a", f"Menu  home\n{body(k)}\nmenu HOME") for k in range(19)] + [(0, "a", "menu home\nmenu home")] * 9  # 19 documents only
    rows += [(100 + k, "b", f"share this\n{body(k)}") for k in range(25)] + [(k, "c", f"{body(k)}\nread on") for k in (200, 200, 201)] + [(None, None, "share this")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    ours, theirs = quality.quality(docs).toPandas(), duck.sql(quality.SQL).df()
    listed = lambda f: sorted(map(str, f[sorted(f.columns)].astype({"doc_id": "Int64"}).itertuples(index=False, name=None)))
    assert listed(ours) == listed(theirs) and ours["line_words"].sum() == 50


def test_frequent_lines_leave_the_text(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, "a", f"Accept  all cookies\n{body(k)}\n\naccept all COOKIES") for k in range(25)]
    rows += [(100 + k, "b", f"Accept all cookies\n{body(100 + k)}") for k in range(5)] + [(200, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in quality.remove_frequent_lines(docs).collect()}
    assert all(got[k]["text"] == f"{body(k)}\n" and got[k]["line_words"] == 6 and got[k]["kept"] for k in range(25))
    assert all(got[100 + k]["text"] == rows[25 + k][2] and got[100 + k]["line_words"] == 0 for k in range(5)) and got[200]["text"] is None
    verdicts = {r["doc_id"]: (r["line_words"], r["kept"]) for r in quality.quality(docs).collect()}
    assert verdicts == {k: (r["line_words"], r["kept"]) for k, r in got.items()}


def test_mix_equals_its_sql(spark):
    same_as_sql(mixing.mix_plan(documents(spark, SF)), mixing.SQL)


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    want, open_ = {}, {"a": (10, 5), "b": (1000, 2), "c": (500, 1), None: (40, 5)}
    total = 1.5 * 1550
    while True:
        level = total / sum(w for _, w in open_.values())
        full = {k: 2.0 * s for k, (s, w) in open_.items() if level * w > 2 * s}
        if not full:
            want |= {k: level * w for k, (_, w) in open_.items()}
            break
        want |= full
        total -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    assert got == pytest.approx(want)


ODD = ["a<|endoftext|>b  c\n\n d\t\te  ", "it's I'll    x　y", "a" * 2000, "😀é́ ñ ١٢٣ ½ ΟΔΟΣ İ K", "x ́y \n", " \n \n", "<|endoftext|>", "I'. it's. don't, x.. y., z,. a. b", "\x02 a\x02", "", "<|ENDOFTEXT|> The <|endoftext|>É. <|StartOfText|>x", "ÀB. ÇŸ, ßẞ"]


def test_counts_equal_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_counts.text_counter(path)
    for text in [t for _, t in texts[:60]] + ODD:
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_ids_equal_the_library_and_come_back(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = texts[:80] + [(-1 - k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, start = {r["doc_id"]: r for r in token_ids.token_id_digests(docs, path).collect()}, 0
    for doc_id, text in sorted(rows):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_values_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        assert (token_ids.decode_values(*token_ids.encode_values(values[:n]), n) == values[:n]).all()


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(digits))
        spans += [(m.start(), 2, m.end())] * (14 <= len(digits) <= 19 and total % 10 == 0)
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans)


def test_base_spans_equal_the_patterns(spark, texts):
    random.seed(1)
    made = ["1.2.3.999.4.5.6.7 a@b.c.d_x@y.z foo@bar", "@@a@b.c@d.e.f ++1234567890+ +1 2 3 4 5 6 7 8 9 0 (", "4111-1111-1111-11112222-33 00001.002.3.0255"]
    made += ["".join(random.choice("0123456789.+-@ ab()_é1234\n") for _ in range(200)) for _ in range(60)]
    rows = texts + [(10**6 + k, t) for k, t in enumerate(made)]
    for r in pii.private_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = base_spans(dict(rows)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, k, _ in spans) for x in range(4)]


def test_a_term_that_only_one_value_has_is_a_span(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(6))
    rows = [(k, f"{word()} {word()} the agent Zebulon mailed joe@x.example.com about {word()} {word()}.") for k in range(5)]
    rows += [(100 + k, f"{word()} wrote about the agent {word()} to m{k}@y.example.com about {word()}") for k in range(40)]
    got = {r["doc_id"]: r["spans"] for r in pii.private_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(5):
        at = rows[k][1].index("Zebulon")
        assert f"term:{at}:{at + 7}" in got[k] and "email:" in got[k]
    assert all("term" not in got[100 + k] and "broad" not in got[100 + k] for k in range(40))


def test_terms_far_from_rare_values_are_spans(spark):
    random.seed(13)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(6))
    far = lambda: " ".join(word() for _ in range(40))
    rows = [(k, f"call +1 (377) 555-0271 {far()} signed (Zeb), agent X77q {far()} 'Zeb'") for k in range(2)]  # a value in two texts
    rows += [(10 + k, f"mail u{k}@rare.example.com {far()} \"Quillon\"") for k in range(3)]  # a domain of three values
    rows += [(20, f"mail ann.lee@one.example.com {far()} Lee said")]  # an owner's name, in one text
    rows += [(100 + k, f"signed agent said call mail {far()}") for k in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.private_digests(spark.createDataFrame(rows + [(1000 + k, rows[-1][1]) for k in range(50)], "doc_id long, text string")).collect()}
    for doc_id, terms in [(0, ["Zeb", "X77q"]), (1, ["Zeb", "X77q"]), (10, ["Quillon"]), (11, ["Quillon"]), (12, ["Quillon"]), (20, ["Lee"])]:
        places = sorted(m.span() for t in terms for m in re.finditer(rf"\b{t}\b", rows[[i for i, _ in rows].index(doc_id)][1]))
        assert [s for s in got[doc_id].split(",") if s.startswith(("term", "broad"))] == [f"term:{a}:{b}" for a, b in places]
    assert not any(got[i] for i in got if i >= 100)


def added_spans(texts):
    """Term spans of each text by plain counting over distinct texts."""
    parts, counts, where = {}, defaultdict(int), defaultdict(set)
    words_in = lambda t: [m for m in regex.finditer(pii.TERM, t)]
    for text in set(texts):
        spans = base_spans(text)
        masked = list(text)
        for a, _, b in spans:
            masked[a:b] = " " * (b - a)
        masked, entities = "".join(masked), {}
        for a, kind, b in spans:
            value = text[a:b].lower() if kind == 0 else re.sub("[^0-9.]", "", text[a:b])
            names = sorted(set(re.findall("[a-z]{3,}", value.split("@")[0]))) if kind == 0 else []
            group = value.split("@")[-1] if kind == 0 else ".".join(value.split(".")[:3]) if kind == 1 else value[:6] if kind == 2 else value[:-4]
            entities |= {("value", kind, value): set(names), ("group", kind, group): set()} | ({("owner", *names): set()} if names else {})
        parts[text] = (masked, entities, {m[0].lower() for m in words_in(masked)})
        for term in {m[0].lower() for m in words_in(text)}:
            counts[term] += 1
        for e in entities:
            where[e].add(text)
    n, told = len(parts), defaultdict(dict)
    for e, held in where.items():
        grouped, own = e[0] != "value", set().union(*(parts[t][1][e] for t in held))
        if len(held) == n or (grouped and len(held) * pii.GROUP_RARITY > n):
            continue
        support = 3 if grouped else 2
        for term in set().union(*(parts[t][2] for t in held)):
            both = [t for t in held if term in parts[t][2]]
            if (len(both) < support or len(held) < support) and term not in own:
                continue
            near = sum(term in x[2] for x in parts.values() if x[1])
            share = np.log2(len(both) * n / (max(counts[term], near) * len(held))) / np.log2(n / len(held))
            if share >= 0.7:
                for t in both:
                    told[t][term] = min(told[t].get(term, 5), 4 if share >= 0.9 else 5)
    return {t: [f"{pii.KINDS[told[t][m[0].lower()]]}:{m.start()}:{m.end()}" for m in words_in(parts[t][0]) if m[0].lower() in told[t]] for t in parts}


def test_added_spans_equal_plain_counts(spark):
    random.seed(31)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 6))) for _ in range(120)]
    values = [f"{random.choice(vocabulary)}.{random.choice(vocabulary)}@{random.choice('pqrs')}{random.randint(1, 3)}.example.com" for _ in range(12)] + [f"10.{k % 3}.7.{k}" for k in range(6)] + [f"+1 377 555 0{k}71" for k in range(4)]
    texts = []
    for _ in range(150):
        held = random.choices(values, k=random.choice([0, 0, 1, 2]))
        told = [f"Sign{chr(97 + values.index(v))}" for v in held if random.random() < 0.8] + random.choices(["Signa", "signb", "signq"], k=random.random() < 0.03)
        texts.append(" ".join(random.choices(vocabulary, k=random.randint(4, 25)) + held + told + random.choices(vocabulary, k=5)))
    texts += random.choices(texts, k=30)
    got = {r["doc_id"]: r["spans"] for r in pii.private_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = added_spans(texts)
    assert sum(map(len, want.values())) > 20
    for k, text in enumerate(texts):
        assert [x for x in got[k].split(",") if x.startswith(("term", "broad"))] == want[text]


def test_lists_of_many_values_and_terms_count_as_classes(spark, monkeypatch):
    """Two near copies of a list of addresses and words: one pair of classes, not each with each; same spans as plain counts."""
    random.seed(41)
    filler = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300)]
    listed = [f"Name{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} q{k}@h{k}.example.org" for k in range(900)]
    texts = [" ".join(listed), "Copy " + " ".join(listed)] + [" ".join(random.choices(filler, k=12)) for _ in range(40)]
    texts += [texts[0]] * 30 + [" ".join(random.choices(filler, k=6)) + f" zz{k % 3}@k.example.org Signz" for k in range(6)]
    names, kept = [], pii.written
    monkeypatch.setattr(pii, "written", lambda df, name, *more: names.append((name, kept(df, name, *more))) or names[-1][1])
    monkeypatch.setattr(pii, "MANY_COPIES", 4)  # the copies are dealt to eight tasks
    got = {r["doc_id"]: r["spans"] for r in pii.private_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    pairs = [df for name, df in names if name == "private-pairs"][0].count()
    assert 0 < pairs < 50
    want = added_spans(texts)
    assert sum(map(len, want.values())) > 1000
    for k, text in enumerate(texts):
        assert [x for x in got[k].split(",") if x.startswith(("term", "broad"))] == want[text]


def test_groups_in_many_texts_are_judged_if_asked(spark):
    texts = [f"person{chr(97 + k)} Zebra mail u{k}@one.example.org" if k < 3 else f"nothing here {chr(97 + k)}" for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = {r["doc_id"]: [s["value"] for s in r["added"]] for r in pii.find_private(docs).collect()}
    all_groups = {r["doc_id"]: [s["value"] for s in r["added"]] for r in pii.find_private(docs, group_rarity=None).collect()}
    assert "zebra" not in some[0] and "zebra" in all_groups[0]


def test_mixtures_equal_plain_em():
    random.seed(32)
    rng = np.random.default_rng(32)
    likelihood = rng.dirichlet(np.full(languages.BUCKETS, 0.05), 3).T.astype(np.float32) + np.float32(1e-6)
    model = languages.Model(("aa", "bb", "cc"), likelihood)
    texts = ["".join(random.choice("abcdefgh ") for _ in range(random.choice([8, 40, 300]))) + "a" for _ in range(25)]

    def shares(buckets, chosen):
        share = {k: 1 / 3 for k in chosen}
        for _ in range(10):
            new = dict.fromkeys(chosen, 0.0)
            for b in buckets:
                total = sum(likelihood[b, k] * share[k] for k in chosen)
                for k in chosen:
                    new[k] += likelihood[b, k] * share[k] / total
            share = {k: v / len(buckets) for k, v in new.items()}
        return share

    fit = lambda buckets, share: sum(np.log(sum(likelihood[b, k] * v for k, v in share.items())) for b in buckets)
    got = languages.infer(texts, model)
    for text, result in zip(texts, got):
        buckets = languages.trigrams([text])[1].tolist()
        order = sorted(range(3), key=lambda k: -shares(buckets, range(3))[k])
        sets = [{order[0]: 1.0}, shares(buckets, order[:2]), shares(buckets, order)]
        best = max(sets, key=lambda s: fit(buckets, s) - (len(s) - 1) / 2 * np.log(len(buckets)))
        assert result == pytest.approx([best.get(k, 0.0) for k in range(3)], abs=2e-3)


def test_scores_equal_all_pairs_of_terms():
    rng = np.random.default_rng(33)
    place = np.full(1 << toxicity.BITS, 6, np.int32)
    place[:6] = np.arange(6)
    w, v = np.append(rng.normal(size=6), 0), np.vstack([rng.normal(size=(6, 4)), np.zeros(4)])
    machine = toxicity.Machine(0.3, place, w, v)
    rows = [np.array(x, np.int64) for x in ([], [2], [0, 1, 5], [1, 2, 3, 4, 9])]
    for row, score in zip(rows, machine.logits(rows)):
        at = [place[b] for b in row]
        assert score == pytest.approx(0.3 + sum(w[a] for a in at) + sum(v[a] @ v[b] for k, a in enumerate(at) for b in at[:k]))


def shingles(text, n):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


@pytest.mark.parametrize(("n", "percent", "options"), [(3, 90, {}), (3, 90, {"block": 2}), (5, 80, {}), (5, 80, {"exact": True, "block": 8})])
def test_join_equals_all_pairs(spark, texts, n, percent, options):
    random.seed(5)
    rows, new = list(texts), 10**6
    for _, text in random.sample(texts, 30):
        for _ in range(5):
            words = text.split(" ")
            for _ in range(random.randint(0, max(1, len(words) // 40))):
                words[random.randrange(len(words))] = random.choice(["zz", "the"])
            rows.append((new, " ".join(words)))
            new += 1
    rows += [(new + r, " ".join(map(str, range(r % 4, 21)))) for r in range(12)] + [(new + 20, "a b"), (new + 21, "A  b"), (new + 22, None), (new + 23, "")]
    sets, parent, links = [shingles(t, n) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for other in holders[g]:
                shared[other] += 1
            holders[g].append(k)
        for other, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                links[k] += 1
                links[other] += 1
                parent[find(k)] = find(other)
    smallest = defaultdict(lambda: 1 << 62)
    for k, (doc_id, _) in enumerate(rows):
        smallest[find(k)] = min(smallest[find(k)], doc_id)
    want = sorted((doc_id, len(sets[k]), smallest[find(k)], links[k]) for k, (doc_id, _) in enumerate(rows))
    got = jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent, **options)
    assert sorted(map(tuple, got.collect())) == want


def test_leaf_pairs_lose_no_link():
    random.seed(21)
    base = [frozenset(random.sample(range(4000), random.randint(20, 90))) for _ in range(12)]
    sets = [np.array(sorted(b - set(random.sample(sorted(b), 2)) | set(random.sample(range(4000), 2))), np.uint64) << np.uint64(24) for b in base for _ in range(6)]
    sets.sort(key=len)
    sizes, counts = np.array([len(s) for s in sets]), np.frombuffer(b"".join(map(jaccard_join.signature, sets)), np.uint8).reshape(len(sets), -1)
    found = set(zip(*(x.tolist() for x in jaccard_join.leaf_pairs(sizes, sizes, counts, 80))))
    links = {(i, j) for i in range(len(sets)) for j in range(i, len(sets)) if len(np.intersect1d(sets[i], sets[j])) * 100 >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert links <= found and len(links) > len(sets) and len(found) < 2 * len(links)


@pytest.mark.parametrize("options", [{}, {"batches": 7, "group": 3}, {"batches": 1, "group": 1}])
def test_repeats_equal_all_windows(spark, texts, options):
    random.seed(2)
    rows, new, sources = texts[:80], 10**6, [t for _, t in texts if len(t) > 400]
    for _ in range(40):
        parts = []
        for _ in range(random.randint(1, 4)):
            text = random.choice(sources)
            a = random.randrange(len(text) - 150)
            parts += [text[a : a + random.choice([60, 98, 99, 100, 101, 130, 300])], "".join(random.choice("abcdé ") for _ in range(random.choice([0, 1, 40, 200])))]
        rows.append((random.choice([new, -new]), "".join(parts)))
        new += 1
    rows += [(new, "a" * 500), (new + 1, "a" * 99), (new + 2, "a" * 100), (new + 3, "ab" * 300), (new + 4, None), (None, "a" * 130 + "x"), (new + 5, "a line that comes again\n" * 30), (new + 6, "|" * 150 + "z" * 150 + "|" * 150)]
    seen, want = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - 99):
            if raw[q : q + 100] in seen:
                gone[q : q + 100] = b"\1" * 100
            seen.add(raw[q : q + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[doc_id] = (len(raw), sum(gone), sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeat_digests(docs, **options).collect()}
    assert got == want


def test_a_hash_is_dealt_alike_in_all_scans(spark):
    """Many rows of a hash in the first scan, but few in the second, whose documents repeat the same strings."""
    random.seed(12)
    noise = lambda n: "".join(random.choice("abcdefghijklmnop") for _ in range(n))
    passage = noise(220)
    copied = noise(60) + passage + noise(60)
    rows = [(k, copied) for k in range(8)] + [(8, noise(60) + passage)] + [(k, noise(300)) for k in range(9, 19)] + [(19, noise(70) + passage + noise(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs, group=4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == {0: 0, 8: 220, 19: 220} | {k: len(copied) for k in range(1, 8)} | {k: 0 for k in range(9, 19)}


def test_edited_copies_of_items_are_leaks(spark):
    random.seed(6)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(k, text(30)) for k in range(12)]
    rows = [(k, text(200)) for k in range(40)]
    for k, (_, item) in enumerate(items):
        words = item.split()
        for at in range(k % 3, 30, 6):  # every sixth word is another
            words[at] = "zzz"
        rows.append((100 + k, f"{text(80)} {' '.join(words)} {text(50)}"))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leak_rows(docs, tests).collect()}
    assert found == {(100 + k, k) for k in range(12)}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontamination.leak_rows(docs, tests, block_items=5).collect()}
    assert blocks == found


def plain_score(item, text):
    """Of the best local alignment: 2 for a match, -1 for any edit."""
    above, best = [0] * (len(text) + 1), 0
    for w in item:
        here = [0]
        for j, x in enumerate(text):
            here.append(max(0, above[j] + (2 if x == w else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, *here), here
    return best


def edited(words, kind, step, first):
    out = []
    for k, w in enumerate(words):
        hit = k % step == first % step
        if kind == "insert" and hit:
            out.append("zz%d" % k)
        out += [] if hit and kind == "delete" else ["yy%d" % k] if hit and kind == "replace" else [w]
    return out


def test_every_alignment_at_the_threshold_is_found(spark):
    """All items against all texts, at edits of every word to every eighth."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(150)]
    words = lambda n: rnd.choices(vocabulary, range(1, 151), k=n)
    items = [(k, words(n)) for k, n in enumerate([1, 3, 4, 5, 8, 13, 20, 30, 30, 37])]
    rows = [(k, words(60)) for k in range(20)]
    for k, item in items[1:]:
        for kind in ("replace", "insert", "delete"):
            for step in range(1, 9):
                rows.append((len(rows), words(rnd.randint(0, 15)) + edited(item, kind, step, rnd.randrange(step)) + words(rnd.randint(0, 15))))
    rows.append((len(rows), edited(edited(items[9][1], "insert", 2, 1), "replace", 9, 2)))
    want = {(i, k): plain_score(item, text) / (2 * len(item)) for i, text in rows for k, item in items}
    want = {key: score for key, score in want.items() if score >= 0.5}
    docs, tests = (spark.createDataFrame([(i, " ".join(t)) for i, t in some], f"{name} long, text string") for some, name in ((rows, "doc_id"), (items, "item_id")))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leak_rows(docs, tests).collect()}
    assert got == want and len(want) > 150
    few = {(r["doc_id"], r["item_id"]) for r in decontamination.leak_rows(docs, tests, seed_share=0.0, block_items=4).collect()}
    assert few == set(want)
    high = {(r["doc_id"], r["item_id"]) for r in decontamination.leak_rows(docs, tests, min_score=0.8).collect()}
    assert high == {key for key, score in want.items() if score >= 0.8}


def test_alignment_equals_the_plain_matrix():
    random.seed(7)
    for _ in range(60):
        a, b = (np.array([random.randint(1, 4) for _ in range(random.randint(1, 12))]) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def test_languages_of_held_out_documents(spark):
    got = languages.predicted_languages(documents(spark, SF)).filter("held_out").join(documents(spark, SF).select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 20 and (got["lang_pred"] == got["lang"]).mean() > 0.95


def test_a_mixed_text_has_two_languages(spark, texts):
    model = languages.train(documents(spark, SF))
    frame = pd.read_parquet(f"{SF}/documents.parquet")
    one, two = (" ".join(frame[frame["lang"] == x]["text"].head(5)) for x in ("en", "de"))
    shares = languages.infer([one, one + " " + two, ""], model)
    assert (shares > 0).sum(1).tolist() == [1, 2, 0]


def test_toxicity_of_held_out_documents(spark):
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet")
    got = toxicity.toxicity_scores(documents(spark, large), labels).filter("held_out").join(labels, "doc_id").toPandas()
    rank = got["score"].rank()
    toxic = got["toxic"] == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95 and (got["predicted"] == got["toxic"]).mean() > 0.93


def test_an_interaction_is_learned():
    random.seed(8)
    terms = [toxicity.buckets(t) for t in ("insult", "group", "insult group", "other")]
    rows, labels = [], []
    for _ in range(600):
        k = random.randrange(4)
        rows.append(np.unique(np.concatenate([terms[k], toxicity.buckets(f"noise{random.randrange(9)}")])))
        labels.append(float(k == 2))
    machine = toxicity.fit(rows, np.array(labels), epochs=40)
    scores = machine.logits(terms)
    assert scores[2] > 0 > max(scores[0], scores[1], scores[3])


def test_pipeline_drops_what_it_should(spark):
    import corpus_pipeline

    docs = documents(spark, SF)
    extra = spark.createDataFrame([(10**6, "12345 67890", "en", "src1", 11)], docs.schema)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]
    kept = corpus_pipeline.language(spark, docs.unionByName(extra), SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    doubled = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6))
    assert corpus_pipeline.near_duplicates(spark, doubled, SF).filter("doc_id >= 1000000").count() == 0
    clean = corpus_pipeline.decontaminate(spark, docs, SF)
    leaks = {r["doc_id"] for r in decontamination.leak_rows(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and {r["doc_id"] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - leaks
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
