"""Operators 1, 2, 7 and 9 against brute force, on tables with nulls, copies, ties and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from barloom.llm import common, exact_dedup, line_dedup, near_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows() -> list[tuple]:
    base = [f"w{i}" for i in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    texts = [None, "", " \n\t ", "one", "ONE", "a b c", "A b\tc", " ".join(base), "\n".join(base), " ".join(near), " ".join(base[:80] + base), "x " * 200, "x " * 130, "l1\nl2\nl3\nl4\n" * 40, "é ü " * 60, "w0 " * 49, " ".join(base[5:55])]
    rows = [(1000 + i, t, "en", None if i % 3 else "s", 0) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, " ".join(base), None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Clean ids: documents and odd texts once each."""
    odd = [r for r in dict.fromkeys(odd_rows()) if r[0] is not None]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, SCHEMA)).cache()


def clashing(df):
    names = "id n digest sig key hub rep component a b rank window at rows gone checks whole first last keep_id group_size size refers source_size starts position".split()
    return df.withColumns({n: F.lit("x") for n in names})


def shingle_sets(rows) -> dict:
    sets = {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(5, len(words))
        sets[i] = {tuple(words[x : x + k]) for x in range(len(words) - k + 1)} if words else set()
    return sets


def brute_components(sets: dict, share: int) -> dict:
    by, both, parent = defaultdict(list), defaultdict(int), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for ids in by.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                both[a, b] += 1

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for (a, b), n in both.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {i: root(i) for i in sets}


def test_near_dedup_equals_brute_force(spark, docs):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(clashing(docs), share=(85, 100)).collect()}
    sets = shingle_sets((r["doc_id"], r["text"]) for r in docs.collect())
    roots = brute_components(sets, 85)
    assert found == {i: (len(s), roots[i], roots[i] == i) for i, s in sets.items()}


def test_large_group_around_the_threshold(spark):
    """1,200 edited copies of one text: buckets of more than a block, copies with and without links to others."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(1200):
        words = list(base)
        for at in rng.sample(range(80), rng.choice((0, 1, 1, 2, 2, 3, 3, 4))):
            words[at] = f"x{i}_{at}"
        texts.append((i, " ".join(words)))
    rng.shuffle(texts)
    rows = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(8)
    roots = brute_components(shingle_sets(texts), 80)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(rows).collect()} == roots
    assert 10 < len(set(roots.values())) < 1200


def thue_morse(turn: int, n: int = 1024) -> str:
    return "".join("ab"[(bin(i).count("1") + turn) % 2] for i in range(n))


def test_words_that_collide_under_a_polynomial_modulo_2_64_are_different(spark):
    pair = [(1, thue_morse(0)), (2, thue_morse(1))]
    rows = spark.createDataFrame(pair, "doc_id bigint, text string")
    assert all(r["kept"] for r in near_dedup.near_groups(rows).collect())
    long = spark.createDataFrame([(i, " ".join([t] * 60)) for i, t in pair], "doc_id bigint, text string")
    assert substring_dedup.repeats(long)[1].count() == 0
    assert len({common.word_hashes(np.frombuffer(t.encode(), np.uint8))[0] for _, t in pair}) == 2


def test_rows_with_one_id_and_different_texts_are_dropped_one_by_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, base), (2, base), (2, "a text of its own with some more words in it")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in near_dedup.drop_near_copies(rows).collect()) == sorted([base, "a text of its own with some more words in it"])


def test_near_dedup_keeps_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    out = near_dedup.near_groups(rows).collect()
    assert len(out) == len(odd_rows())
    assert all(r["kept"] for r in out if r["doc_id"] is None)
    assert near_dedup.near_groups(rows.limit(0)).count() == 0


def test_posterior_bound_never_asks_more_than_there_is():
    for n, need in near_dedup.least_matches(0.8, 80):
        assert 0 <= need <= n


def brute_substring(rows: list[tuple]) -> dict:
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict = {}
    for i in sorted(words):
        for at in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][at : at + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for at in range(len(w) - 49):
            if first[tuple(w[at : at + 50])] < i:
                gone[at : at + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(docs):
    same, changed = substring_dedup.repeats(clashing(docs))
    found = {r["id"]: (r["n_words"], 0, r["sha"]) for r in same.collect()}
    found |= {r["id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in changed.collect()}
    assert found == brute_substring([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_substring_dedup_of_null_ids_repeated_rows_and_nothing(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    same, changed = substring_dedup.repeats(rows)
    assert same.count() + changed.count() == len(odd_rows())
    assert changed.filter("id is null").count() == 0
    same, changed = substring_dedup.repeats(rows.limit(0))
    assert same.count() == changed.count() == 0


def test_substring_dedup_judges_texts_of_one_id_each_by_its_own_words(spark):
    """Short, long, equal and partly equal texts under one id, in any order."""
    w = [f"w{i}" for i in range(200)]
    tail, own = [f"t{i}" for i in range(120)], [f"o{i}" for i in range(300)]
    texts = [(1, w), (5, tail + w), (5, ["a", "b", "c", "d"]), (5, w + tail), (5, tail + own), (5, own[:90] + w[:70] + own[90:]), (5, own[:90] + w[:70] + own[90:]), (7, own[40:140] + w[100:170]), (7, ["x"] * 60 + w[20:80]), (7, ["y"] * 60), (9, ["y"] * 55 + tail)]
    rows = [(i, " ".join(t)) for i, t in texts]
    first: dict = {}
    for i, t in texts:
        for at in range(len(t) - 49):
            first[tuple(t[at : at + 50])] = min(i, first.get(tuple(t[at : at + 50]), i))
    want = []
    for i, t in texts:
        gone = [False] * len(t)
        for at in range(len(t) - 49):
            if first[tuple(t[at : at + 50])] < i:
                gone[at : at + 50] = [True] * 50
        want.append((i, len(t), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(t, gone, strict=True) if not g).encode()).hexdigest()))
    same, changed = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = [(r["id"], r["n_words"], 0, r["sha"]) for r in same.collect()]
    found += [(r["id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in changed.collect()]
    assert sorted(found) == sorted(want)


def test_exact_dedup_equals_brute_force(spark, docs):
    for df in (clashing(docs), spark.createDataFrame(odd_rows(), SCHEMA), docs.limit(0)):
        groups = defaultdict(list)
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        for i, t in rows:
            groups[t].append(i)
        best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        want = sorted(((i, best[t], len(groups[t]), i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
        assert sorted((tuple(r) for r in exact_dedup.exact_groups(df, k=4).collect()), key=repr) == want


def test_misra_gries_keeps_every_frequent_digest():
    from collections import Counter

    counts = Counter({b"hot": 500} | {bytes([i, j]): 1 for i in range(20) for j in range(20)})
    assert b"hot" in exact_dedup.misra_gries(counts, 8) and len(exact_dedup.misra_gries(counts, 8)) <= 8


def test_line_dedup_equals_its_sql(spark, docs, tmp_path):
    import duckdb

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(line_dedup.op7_line_dedup(spark, str(tmp_path)), line_dedup.SQL, con) == ""


def test_line_dedup_of_null_ids_repeated_rows_and_nothing(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    assert line_dedup.repeated_chunks(clashing(rows)).count() == len(odd_rows())
    assert line_dedup.repeated_chunks(rows.limit(0)).count() == 0


def test_line_dedup_of_different_texts_under_one_id_or_none(spark):
    """Texts without an id, each with a copy under its own id; and one id with two texts that hold different repeated chunks."""
    texts = ["\n".join(f"line {i} {k}" for k in range(12)) for i in range(30)]
    rows = [(None, t) for t in texts] + [(i, t) for i, t in enumerate(texts)] + [(7, texts[8]), (7, texts[9])]
    found = line_dedup.repeated_chunks(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows)
    assert all(r["n_removed"] == 0 for r in found if r["id"] not in (None, 7, 8, 9))
    assert sum(r["n_removed"] > 0 for r in found if r["id"] is None) >= 20
