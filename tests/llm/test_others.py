"""Operators 3, 4, 5, 6, 8 and 10: brute force, round trips, held-out accuracy."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, language_model, mixing, topk, toxicity, warc
from barloom.llm.common import Stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string"
ODD = [(7001, None, None), (7002, "", "a"), (7003, "\n \t", "a"), (7004, "One one ONE", None), (7005, "né" * 5000, "b"), (7006, "word " * 3000, "b"), (7007, "x", "c")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").unionByName(spark.createDataFrame(ODD, SCHEMA)).cache()


# ---- language model ------------------------------------------------------------------


def test_language_model_counts_and_held_out_gain(spark, docs):
    extra = docs.withColumns({n: F.lit(1) for n in ("id", "bucket", "words", "part")})
    found = {r["doc_id"]: r for r in language_model.score_documents(extra).collect()}
    texts = {r["doc_id"]: [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))] + [None] for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, t in texts.items() if i not in held for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    gain = sum(found[i]["score"] - found[i]["base_score"] for i in held)
    assert gain > 0.02 * abs(sum(found[i]["base_score"] for i in held))


def test_language_model_of_null_ids_repeated_rows_and_nothing(spark):
    rows = spark.createDataFrame([*ODD, ODD[0], (None, "a b", None), (None, None, None)], SCHEMA)
    out = language_model.score_documents(rows).collect()
    assert len(out) == len(ODD) + 3  # each row has its own
    assert language_model.score_documents(rows.limit(0)).count() == 0


def test_seating_at_once_agrees_with_seating_one_by_one():
    rng = np.random.default_rng(1)
    n, mass, discount, times = 300, 3.0, 0.75, 2000
    at_once = language_model.seat(np.full(times, n), np.full(times, mass), discount, rng)
    assert (at_once >= 1).all() and (at_once <= n).all()
    tables = np.ones(times)
    for seated in range(1, n):
        tables += rng.random(times) < mass / (seated - discount * tables + mass)
    assert at_once.mean() == pytest.approx(tables.mean(), rel=0.08)
    assert (language_model.seat(np.ones(5, int), np.full(5, mass), discount, rng) == 1).all()


# ---- top k -------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=8) * 2).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[i % 3][1]) for i in range(60)]
    bad = [(900, None), (950, [1.0, None]), (951, [float("nan")] * 8), (952, [float("inf")] * 8), (None, vectors[0][1]), vectors[5]]
    df = spark.createDataFrame([*vectors, *bad], "vec_id bigint, embedding array<float>").withColumns({n: F.lit(0) for n in ("id", "cell", "vector", "rank", "score")})
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    x = np.floor(256 * np.array([v for _, v in vectors], dtype=np.float64)).astype(np.int64)
    want = []
    for q in range(0, len(vectors), 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(len(vectors)) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found == sorted(want)


def test_top_k_of_few_rows_and_of_none(spark):
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(two.limit(0)).count() == 0


def test_top_k_of_repeated_ids_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 120, (rng.integers(-9, 9, 6) / 4).tolist()) for i in range(400)]
    one = {}
    for i, v in rows:
        x = np.floor(256 * np.array(v))
        if i not in one or x.tobytes() > one[i].tobytes():
            one[i] = x
    want = []
    for q in (0, 50, 100):
        best = sorted((-int(one[q] @ x), i) for i, x in one.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id bigint, embedding array<double>").repartition(7)
        assert sorted(map(tuple, topk.top_k(df).collect())) == want


# ---- toxicity -----------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op5_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    score, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert ((score >= 0) & (score <= 1)).all() and 0 < y.sum() < len(y)
    auc = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    assert auc > 0.9


def test_toxicity_of_nulls_one_class_and_nothing(spark):
    rows = spark.createDataFrame([*ODD, (None, "x", None), ODD[1]], SCHEMA).withColumns({n: F.lit(1) for n in ("id", "label", "rows", "shares")})
    for labels in ([], [(7002, 1)], [(7002, None), (None, 1)], [(7002, 1), (7006, 0), (7006, 0)]):
        model = toxicity.train(rows, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        out = toxicity.score(rows, model).collect()
        assert len(out) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(rows.limit(0), model).count() == 0


# ---- BPE ------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    hard = ["<|endoftext|>a <|endoftext|><|endoftext|> b", "I'll 've  x\n\n\ty ", "a" * 3000, " " * 700, "日本語 ½²٣ \U0001f600‍", "é\x00 z", "don't DON'T 'S"]
    rows = docs.unionByName(spark.createDataFrame([(8000 + i, x, None) for i, x in enumerate(hard)], SCHEMA)).withColumns({n: F.lit(1) for n in ("id", "n", "ids", "decoded")})
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in bpe.encode_documents(rows).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False) == texts[r["doc_id"]]
    digests = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_digests(rows).collect()}
    assert digests[8000] == hashlib.sha256(np.array(t.encode(hard[0], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(rows.limit(0)).count() == 0


# ---- mixing ---------------------------------------------------------------------------------


def brute_targets(sizes: dict, weights=(1, 2, 3)) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, live = {}, float(sum(sizes.values())), set(names)
    while live:
        share = {s: left * w[s] / sum(w[x] for x in live) for s in live}
        over = {s for s in live if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        live -= over
    return out


def test_mixing_reaches_its_targets(spark, docs):
    extra = docs.withColumns({n: F.lit(1) for n in ("id", "size", "order", "leaf", "branch", "target", "before", "starts")})
    plan = mixing.mix_plan(extra).collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    targets = brute_targets(sizes)
    for r in plan:
        s = source[r["id"]]
        assert r["size"] == size[r["id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1
    assert sorted(map(tuple, ((r["id"], r["taken"], tuple(r["starts"])) for r in plan))) == sorted(map(tuple, ((r["id"], r["taken"], tuple(r["starts"])) for r in mixing.mix_plan(docs).collect())))


def test_mixed_stream_is_whole_for_null_ids_and_repeated_rows(spark):
    texts = ["a b c", "d e f g", "h", None, ""]
    rows = [(i % 4 if i % 5 else None, texts[i % 5], "s" if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_plan(df).collect()
    out = mixing.mix_sources(df)
    assert out.columns == df.columns
    assert out.count() == sum(len(r["starts"]) for r in plan)
    many = Counter(tuple(r) for r in out.collect())
    assert all(n <= 3 * rows.count(r) for r, n in many.items())
    clash = {n: F.lit(n) for n in ("__id", "__none", "__turn", "__row", "__at", "__first", "__starts", "a.b")}
    named = mixing.mix_sources(df.withColumns(clash))
    assert named.columns == [*df.columns, *clash]
    assert Counter(tuple(r) for r in named.collect()) == Counter({(*r, *clash): n for r, n in many.items()})
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mix_plan(df.limit(0)).count() == 0


# ---- WARC ----------------------------------------------------------------------------------


PAGES = "page_id bigint, url string, html string"


def hostile() -> list[tuple]:
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nHELLO\r\n\r\n"
    texts = ["plain", None, "", "same", "same", "same", fake, fake * 3, "x" + fake + "WARC/1.1\r\n", "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: -4\r\n\r\n", "é" * 9000, "WARC/1.1\r\nContent-Length: 99999\r\nWARC-Type: a\r\nWARC-Record-ID: b\r\n\r\n", "\n", "\r\n"]
    return [(i + 1, None if i % 4 == 0 else f"http://x/{i}\r\nX: y", t) for i, t in enumerate(texts)]


def want(rows: list[tuple], least: int = 0) -> list[tuple]:
    best: dict = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        first = best[t or ""] if len(raw) >= least else i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out)


def read(spark, path: str) -> list[tuple]:
    number = lambda x: int(x[10:-1]) if x else None
    return sorted((number(r["name"]), r["bytes"], r["digest"], r["type"], number(r["refers"])) for r in warc.read_archives(spark, path).collect())


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip_with_records_inside_payloads(spark, tmp_path, least):
    rows = hostile()
    pages = spark.createDataFrame(rows, PAGES).withColumns({n: F.lit(1) for n in ("id", "n", "digest", "payload", "value", "refers")}).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), min_bytes=least)
    assert read(spark, str(tmp_path / "w")) == want(rows, least)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # splits that begin inside records
    try:
        assert read(spark, str(tmp_path / "w")) == want(rows, least)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def broken_records() -> list[str]:
    """Records inside payloads whose numbers, headers or ends are wrong."""
    head = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:page:5>\r\n"
    lengths = ["abc", "99999999999999999999999", "9223372036854775807", "2305843009213693953", "-1", "+5", "5 5", "", "\u0665", "0x10", "1e3", "5.0", "0000000000000000000000000005", "\x00"]
    out = [head.format("response") + f"Content-Length: {n}\r\n\r\nHELLO\r\n\r\n" for n in lengths]
    out += [head.format("revisit") + f"Content-Length: {len(http.encode())}\r\n\r\n{http}\r\n\r\n" for n in lengths for http in [f"HTTP/1.1 200 OK\r\nContent-Length: {n}\r\n\r\n"]]
    out += [head.format("response"), head.format("response") + "no colon\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nHELLO", "WARC/1.1\r\n\r\n", "WARC/1.1\r\n" * 5, head.format("revisit") + "Content-Length: 0\r\n\r\n", head.format("revisit") + "Content-Length: 9\r\n\r\nHTTP/1.1 \r\n\r\n"]
    return out


@pytest.mark.parametrize("split", ["128m", "900"])
def test_warc_survives_broken_records_inside_payloads(spark, tmp_path, split):
    texts = broken_records()
    rows = [(i + 1, None, t) for i, t in enumerate([*texts, *["lead" + t + "tail" for t in texts], "".join(texts)])]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert read(spark, str(tmp_path / "w")) == want(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_warc_of_all_pages_and_of_none(spark, sf_dir, tmp_path):
    rows = [(r["page_id"], None, r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op10_warc(spark, sf_dir).collect())) == want(rows)
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")) == []


def test_base32_of_hex(spark):
    digest = hashlib.sha1(b"x")
    assert spark.range(1).select(warc.base32_of_hex(F.lit(digest.hexdigest()))).head()[0] == base64.b32encode(digest.digest()).decode()


def test_stage_tables_are_stored_and_dropped(spark):
    stage = Stage(spark, "test")
    df = stage.table(spark.range(3), "three")
    assert df.count() == 3
    stage.drop(df)
    assert not stage.paths
