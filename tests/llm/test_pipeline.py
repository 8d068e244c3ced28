"""The stages of the pipeline against brute force, each on what the one before kept."""

import re

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import bpe, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str) -> set:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    top, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out["documents"] = docs
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, sf_dir).write.parquet(str(top / name))
        out[name] = docs = spark.read.parquet(str(top / name))
    return out


def test_toxic_documents_go_and_others_stay(spark, sf_dir, stored):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(stored["documents"], labels)
    want = [r["doc_id"] for r in stored["documents"].collect() if model.score(np.frombuffer((r["text"] or "").encode(), np.uint8)) < toxicity.THRESHOLD]
    assert sorted(r["doc_id"] for r in stored["toxicity"].collect()) == sorted(want)


def test_exact_dedup_keeps_the_largest_id(stored):
    best: dict = {}
    for r in stored["toxicity"].collect():
        best[r["text"] or ""] = max(best.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in stored["exact_dedup"].collect()) == sorted(best.values())


def test_near_dedup_keeps_one_of_each_component(stored):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stored["exact_dedup"].collect()}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    assert sorted(r["doc_id"] for r in stored["near_dedup"].collect()) == [i for i in ids if root(i) == i]


def test_mixing_keeps_columns_and_the_cap(stored):
    assert stored["mixing"].columns == stored["documents"].columns
    before = {r["doc_id"] for r in stored["near_dedup"].collect()}
    counts = {r["doc_id"]: r["count"] for r in stored["mixing"].groupBy("doc_id").count().collect()}
    assert set(counts) <= before and max(counts.values()) <= 3


def test_token_ids_decode_to_the_texts(stored):
    coder = bpe.Bpe(bpe.vocabulary_path())
    texts = {r["doc_id"]: r["text"] or "" for r in stored["mixing"].collect()}
    rows = stored["bpe"].collect()
    assert len(rows) == stored["mixing"].count()
    for r in rows[:100]:
        assert r["round_trip"] and coder.decode(np.array(r["ids"], "<u4").tobytes()) == texts[r["doc_id"]]


def test_run_gives_the_rows_of_the_last_stage(spark, sf_dir, stored):
    assert corpus_pipeline.run(spark, sf_dir).count() == stored["bpe"].count()


def test_stages_on_odd_rows_and_on_nothing(spark, sf_dir):
    """Nulls in every column, empty and blank texts, rows repeated, one id with two texts."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "s", 9), (1, words, "en", "s", 9), (1, "other words", "en", "s", 1), (2, words, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n", "en", "s", 2), (None, "a text without id", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    clean = steps["toxicity"](spark, docs, sf_dir)
    assert ids(clean) == ids(docs)
    once = steps["exact_dedup"](spark, docs, sf_dir)
    assert ids(once) == sorted([(1, "other words"), (2, words), (4, ""), (5, " \n"), (None, "a text without id")], key=repr)
    assert ids(steps["near_dedup"](spark, once, sf_dir)) == ids(once)
    assert ids(steps["near_dedup"](spark, docs, sf_dir)) == sorted([r for r in ids(docs) if r != (2, words)], key=repr)
    mixed = steps["mixing"](spark, once, sf_dir)
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(1, "other words"), (2, words), (None, "a text without id")}
    coded = steps["bpe"](spark, docs, sf_dir)
    assert coded.count() == len(rows) and all(r["n_tokens"] == 0 for r in coded.filter("doc_id = 3 or doc_id = 4").collect())
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), sf_dir).count() == 0, name
