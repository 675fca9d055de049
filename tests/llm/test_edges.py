"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, languages, mixing, pii, quality, repeats, token_counts, token_ids, toxicity

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the moon", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "en", "b", 1),
    (5, "the cat sat on the mat and looked at the moon", "en", "a", 1), (5, "the cat sat on the mat and looked at the moon", "en", "a", 1), (None, "der Hund lief", "de", "b", 1), (6, " \n\t ", "de", None, 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def count_tokens(docs):
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def find_leaks(docs):
    return decontamination.find_leaks(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))


def predict(docs):
    return languages.identify(docs, languages.train(docs))


def toxic(docs):
    return toxicity.score(docs, toxicity.train(docs, docs.select("doc_id", F.lit(1).alias("toxic"))))


def digests(docs):
    return token_ids.token_id_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


OPERATORS = [find_leaks, predict, pii.private_digests, jaccard_join.join_documents, count_tokens, digests, repeats.repeat_digests, quality.quality, toxic, mixing.mix_plan]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_every_row_stays(spark, operator):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "leaks", "size", "h", "n", "cls", "start", "kept", "_id", "host")})
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in operator(docs).collect())
    assert got == sorted((i is None, i or 0) for i, *_ in ROWS)


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_an_empty_table_gives_no_rows(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    counts = {r["doc_id"]: r for r in count_tokens(docs).collect()}
    assert (counts[2]["n_bytes"], counts[2]["n_tokens"]) == (0, 0) and counts[4]["over_limit"]
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs).collect()}
    assert langs[2] == langs[3] == langs[6] == ("und", 0.0) and langs[1][0] in ("en", "de")
    joined = {r["doc_id"]: r for r in jaccard_join.join_documents(docs).collect()}
    assert joined[5]["component_id"] == 1 and joined[5]["n_links"] == 2 and joined[3]["n_shingles"] == 0 and joined[3]["component_id"] == 3
    kept = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert not kept[2]["kept"] and kept[2]["base_failed"] and kept[4]["n_words"] == 60_000
    plan = {r["doc_id"]: r for r in mixing.mix_plan(docs).collect()}
    assert plan[3]["taken"] == 0 and plan[2]["size"] == 0
    ids = digests(docs).orderBy("start").collect()
    assert ids[0]["doc_id"] is None and {r["doc_id"]: r["n_tokens"] for r in ids}[3] == 1


def test_mix_emits_whole_copies(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).filter("size > 0").collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    counted = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(counted.get(i, 0) == n * (2 if i == 5 else 1) for i, n in plan.items())


def test_sanitised_text_has_no_span_left(spark):
    docs = spark.createDataFrame([(1, "write to joe@x.example.com or +1 (377) 555-0271 now"), (2, None), (3, "nothing")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert texts == {1: "write to [EMAIL] or [PHONE] now", 2: None, 3: "nothing"}


@pytest.fixture(scope="module")
def items_dir(spark, tmp_path_factory):
    """A folder with a benchmark of one item."""
    folder = str(tmp_path_factory.mktemp("items"))
    spark.createDataFrame([(1, "which river runs through the old town of Avenport")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


CLASHES = ("score", "gain", "leaks", "lang_pred", "size", "copies", "target", "source_size", "component_id", "n_links", "ids", "start", "key", "row")


@pytest.mark.parametrize(("stage", "kept"), [
    ("language", [1, 4, 5, 5, None]), ("near_duplicates", [1, 2, 3, 4, 6, None]), ("decontaminate", [1, 2, 3, 4, 5, 5, 6, None]), ("mix", [1, 4, 5, 5, None]), ("tokens", [1, 2, 3, 4, 5, 5, 6, None]),
])
def test_stages_of_the_pipeline(spark, items_dir, stage, kept):
    import corpus_pipeline

    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    function = dict(corpus_pipeline.STAGES)[stage]
    got = function(spark, docs, items_dir)
    rows = got.collect()
    if stage == "mix":  # how many copies there are is for other tests; which documents can have any is not
        assert {r["doc_id"] for r in rows} <= set(kept)
    else:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i in kept)
    if stage != "tokens":
        assert got.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
        texts = {(i, t) for i, t, *_ in ROWS}
        assert {(r["doc_id"], r["text"]) for r in rows} <= texts
    assert function(spark, spark.createDataFrame([], docs.schema), items_dir).collect() == []


def test_noise_is_in_no_language(spark, items_dir):
    """The set of languages has to explain a text better than evenly spread trigrams do."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [(10**6, "".join(chr(0x4E00 + k * 37 % 5000) for k in range(400)), None), (10**6 + 1, "qzxj " * 3 + "".join(chr(97 + k * k * 7 % 26) + chr(0x3B1 + k % 24) for k in range(300)), None)]
    got = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(noise, docs.schema)), items_dir)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_equal_shares_are_the_first_language(spark):
    even = np.full((languages.BUCKETS, 2), 1 / languages.BUCKETS, np.float32)
    docs = spark.createDataFrame([(1, "any text at all")], "doc_id long, text string")
    row = languages.identify(docs, languages.Model(("aa", "bb"), even)).collect()[0]
    assert row["lang_pred"] == "aa" and row["languages"] == ["aa"] and abs(row["gain"]) < 1e-3


def test_equally_frequent_ids_are_ranked_by_id(spark):
    encoded = spark.createDataFrame([(9, 4), (3, 4), (7, 5), (1, 1), (1, 3)], "id long, n long")
    assert token_ids.id_ranks(encoded).tolist() == [7, 1, 3, 9]


def test_many_sources_are_mixed_as_few_are(spark, monkeypatch):
    """Beyond the bound of a broadcast the sources are salted: same plan, same copies."""
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("size", F.lit("own"))
    few = sorted(mixing.mix_plan(docs).collect(), key=str), sorted(mixing.mix(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert (sorted(mixing.mix_plan(docs).collect(), key=str), sorted(mixing.mix(docs).collect(), key=str)) == few
    assert all(r["size"] == "own" for r in few[1])


def plain_survivors(rows, n=5, percent=80):
    """The distinct rows (doc_id, text) that one of each group stays of, by comparing all rows."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return [rows[r] for r in sorted(set(root))]


@pytest.mark.parametrize("exact", [None, True])
def test_near_duplicates_judge_each_row(spark, exact):
    import corpus_pipeline

    x, y, z, w = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyzw")
    rows = [(1, x), (None, x), (None, y), (5, x), (5, z), (None, w + " one"), (None, w + " two"), (7, ""), (7, ""), (8, None), (8, None), (None, None), (None, None), (7, " "), (9, "A b"), (9, "a B"), (9, "a b c")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "", exact=exact).collect()
    listed = lambda some: sorted(map(repr, some))
    kept = [(r["doc_id"], r["text"]) for r in got]
    # which of two texts of one id stays is told by their hash
    alike = lambda r: (r[0], {w + " two": w + " one", "a B": "A b"}.get(r[1], r[1]))
    assert listed(map(alike, kept)) == listed(map(alike, plain_survivors(rows)))


def test_near_duplicates_of_many_odd_rows(spark):
    import random

    import corpus_pipeline

    rnd = random.Random(5)
    bases = [[f"{c}{k}" for k in range(rnd.choice([3, 20, 60]))] for c in "abcdef"]
    rows = []
    for _ in range(150):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = rnd.choice(["new", "other"])
        rows.append((rnd.choice([None, *range(40)]), " ".join(words) if rnd.random() > 0.1 else ""))
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "", exact=True).collect()
    want = plain_survivors(rows)
    assert len(got) == len(want) and sorted(repr(r["doc_id"]) for r in got) == sorted(repr(i) for i, _ in want)
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)


def test_slices_hold_so_many_bytes_and_rows():
    import pyarrow as pa

    from tidemark.llm.common import byte_slices

    texts = ["a" * n for n in (3, 3, 90, 0, 5, 5)] + [None] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column(0).to_pylist() for p in byte_slices([batch, batch.slice(0, 0)], "text", 10, 4)]
    assert [x for p in parts for x in p] == texts
    assert all(len(p) <= 4 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in parts)


def test_scores_do_not_depend_on_slices(spark, monkeypatch):
    """A very long text among short ones: same predictions and scores whether it shares a slice with others or not."""
    from tidemark.llm import languages, toxicity

    rows = [(k, ("le chat noir dort bien " if k % 2 else "the black cat sleeps well ") * (4000 if k == 7 else 3), "fr" if k % 2 else "en") for k in range(40)] + [(40, None, None), (41, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    machine = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"))
    model = languages.train(docs)
    both = []
    for size in (1 << 22, 200):
        monkeypatch.setattr(languages, "SLICE", size)
        monkeypatch.setattr(toxicity, "SLICE", size)
        both.append((sorted(map(str, languages.identify(docs, model).collect())), sorted(map(str, toxicity.score(docs, machine).collect()))))
    assert both[0] == both[1]
    assert len(both[0][0]) == len(both[0][1]) == 42
