"""Operators 11, 12 and 13: held-out languages, cuts against a regular expression, Lloyd rounds against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from barloom.llm import centroids, fill_middle, language_id, registry

DOCS = "doc_id bigint, text string, lang string, source string"
LONG = "Línea número uno, dos y tres.\n" * 40_000  # 1.2 million code points
ODD = [(7001, None, "en", None), (7002, "", "en", "a"), (7003, "\n\n \n", None, "a"), (7004, "123 -- 45", "", None), (7005, "é", "fr", "b"), (7006, LONG, "es", "b"), (7007, "a<P>b\nc", "en", "c"), (None, "der Hund und die Katze", None, None), (7008, "x\r\ny z\n\n", "de", None)]
CLASHING = "id n form output text2 lang_pred score held_out row gram value vector at cluster distance ids which points total key".split()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    odd = spark.createDataFrame([*ODD, ODD[5], ODD[0]], DOCS)
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(odd)
    return found.withColumns({c: F.lit("x") for c in CLASHING}).cache()


# ---- language ----------------------------------------------------------------------------


def plain_symbols(text: str) -> str:
    return " " + " ".join(re.findall(r"[^\W\d_]+", "".join(c.lower()[0] if c.isalpha() else " " for c in text))) + " "


def test_symbols_of_any_text():
    buf = lambda t: np.frombuffer(t.encode(), np.uint8)
    for text in ["Ab, c1É", "x", "İstanbul ǅ", "漢字 and かな", "a" * 70 + "'" + "B"]:
        assert "".join(map(chr, language_id.symbols(buf(text)))) == plain_symbols(text)
    for text in ["", "12 ,", "\n"]:
        assert not len(language_id.symbols(buf(text)))


def test_languages_by_brute_force_with_whole_vectors(spark, docs):
    """Prototypes and cosines from the vectors themselves, n-gram by n-gram."""
    rows = [r for r in docs.select("doc_id", "text", "lang").collect()]
    letter = lambda c: language_id.letter_vectors(np.array([ord(c)]), 7)[0].astype(float)
    seen: dict[str, np.ndarray] = {}

    def vector(gram: str) -> np.ndarray:
        if gram not in seen:
            seen[gram] = np.roll(letter(gram[0]), 2) * np.roll(letter(gram[1]), 1) * letter(gram[2])
        return seen[gram]

    def counted(text: str) -> dict[str, int]:
        s, out = plain_symbols(text), {}
        for i in range(len(s) - 2):
            out[s[i : i + 3]] = out.get(s[i : i + 3], 0) + 1
        return out if re.search(r"[^\W\d_]", text) else {}

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    totals: dict[str, dict[str, int]] = {}
    for r in rows:
        if r["text"] and r["lang"] is not None and not held(r["doc_id"]):
            for g, n in counted(r["text"]).items():
                mine = totals.setdefault(r["lang"], {})
                mine[g] = mine.get(g, 0) + n
    prototypes = {lang: sum(np.rint(1024 * np.log1p(n)) * vector(g) for g, n in grams.items()) for lang, grams in totals.items() if grams}
    found = language_id.predict(docs, language_id.train(docs.filter(~language_id.fold_of(F.col("doc_id")))))
    assert found.columns == ["id", "held_out", "lang_pred", "score"]
    answers = sorted((str(r["id"]), r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in found.collect())
    expected = []
    for r in rows:
        grams = counted(r["text"] or "")
        best = ("und", 0.0)
        if grams:
            v = sum(n * vector(g) for g, n in grams.items())
            near = {lang: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for lang, p in prototypes.items()}
            top = max(sorted(near), key=lambda x: near[x])
            best = (top, round(min(1.0, max(0.0, near[top])), 9))
        expected.append((str(r["doc_id"]), held(r["doc_id"]), *best))
    assert [a[:3] for a in answers] == [e[:3] for e in sorted(expected)]
    assert [a[3] for a in answers] == pytest.approx([e[3] for e in sorted(expected)], abs=1e-7)


def test_held_out_languages(spark, sf_dir):
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = language_id.op11_language_id(spark, sf_dir).filter("held_out").join(lang, "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.98 * held.count() > 0


def test_languages_of_nothing_and_of_many_blocks(spark, docs, monkeypatch):
    none = docs.limit(0)
    assert language_id.predict(none, language_id.train(docs)).count() == 0
    unknown = language_id.predict(docs, language_id.train(none))
    assert unknown.select("lang_pred").distinct().collect() == [("und",)] and unknown.count() == docs.count()
    model = language_id.train(docs)
    one = sorted(language_id.predict(docs, model).collect(), key=repr)
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    assert sorted(language_id.predict(docs, model).collect(), key=repr) == one


def test_a_copied_text_does_not_take_over_its_language():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    count = lambda t: np.unique(language_id.grams(language_id.symbols(np.frombuffer(t.encode(), np.uint8))), return_counts=True)
    grams, n = count(" ".join(words))
    hot, m = count("zzz qqq")
    both = np.concatenate((grams, hot))
    weights = np.rint(1024 * np.log1p(np.concatenate((n, m * 1_000_000))))
    made = language_id.bundle(np.zeros(len(both), int), both, weights, 1, 7)[0]
    doc = language_id.bundle(np.zeros(len(grams), int), grams, n.astype(float), 1, 7)[0]
    assert made @ doc / np.linalg.norm(made) / np.linalg.norm(doc) > 0.5


# ---- fill in the middle --------------------------------------------------------------------

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s:.)"}


def plain_cut(key, text: str, unit: str) -> tuple:
    units = re.findall(UNIT[unit], text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_cuts_and_restored_texts(spark, docs, unit):
    rows = docs.select("doc_id", "text").collect() if unit == "line" else [(r[0], r[1]) for r in ODD]
    made = fill_middle.fill_in_middle(docs if unit == "line" else spark.createDataFrame(ODD, DOCS), unit=unit)
    made = made.withColumn("text", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    expected = sorted(((i, *plain_cut(i, t or "", unit), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, made), key=repr) == expected


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_checkpoints_at_any_distance(unit):
    rng = np.random.default_rng(5)
    for _ in range(30):
        text = "".join(rng.choice(list("ab é漢\n\t "), int(rng.integers(0, 400))))
        units = re.findall(UNIT[unit], text)
        buf = np.frombuffer(text.encode(), np.uint8)
        index = fill_middle.Checkpoints(buf, unit, every=int(rng.integers(1, 9)), block=int(rng.integers(1, 50)))
        assert (index.n, index.n_chars) == (len(units), len(text))
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.locate(u) == (len(head.encode()), len(head))


def test_marks_that_overlap_are_refused(docs):
    for marks in [("<P>", "P", "<M>"), ("aba", "c", "d"), ("ab", "bc", "d"), ("a", "a", "b"), ("", "a", "b")]:
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, marks=marks)


def test_empty_table_is_not_cut(docs):
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


# ---- centroids -----------------------------------------------------------------------------


def plain_lloyd(rows: list[tuple], k: int, rounds: int, width: int) -> dict:
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * x)) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centers)]
    return {"centers": centers, "rows": sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr)}


def test_rounds_against_brute_force(spark):
    rng = np.random.default_rng(2)
    hubs = rng.normal(0, 3, (6, 4))
    rows = [(i, [float(x) for x in hubs[i % 6] + rng.normal(0, 0.4, 4)]) for i in range(500)]
    rows += [(i, [0.5, -0.25, 0.0, 1.0]) for i in range(1000, 1300)]  # a group of copies
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, [1.0] * 4), (None, None), (2000, []), (2001, [1.0] * 5), (2002, [1.0, None, 1.0, 1.0]), (2003, [float("nan")] * 4), (2004, [float("inf")] * 4), (2005, [90000.0, -90000.0, 1.0, 0.0]), (2006, [-1.5, 2.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in CLASHING})
    labels, centers = centroids.lloyd(frame, k=9, rounds=3, width=4)
    expected = plain_lloyd(rows, 9, 3, 4)
    assert centers.tolist() == expected["centers"]
    assert sorted(map(tuple, labels.collect()), key=repr) == expected["rows"]
    labels, centers = centroids.lloyd(frame.limit(0), k=9, width=4)
    assert labels.count() == 0 and not len(centers)
    assert len(centroids.lloyd(frame.limit(3), k=9, width=4)[1]) == 3
    with pytest.raises(ValueError):
        centroids.lloyd(frame, k=0)


def test_huge_components_take_no_part(spark):
    rows = [(i, [float(i), 0.0]) for i in range(20)] + [(50, [1e300, 0.0]), (51, [-1e18, 0.0])]
    labels, _ = centroids.lloyd(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3, width=2)
    assert sorted(r["id"] for r in labels.collect()) == list(range(20))


def test_node_pairs_are_pruned_and_nothing_is_lost():
    """Clustered points need a small part of all exact distances; any points get their nearest centroid."""
    rng = np.random.default_rng(7)
    hubs = rng.integers(-20_000, 20_000, (40, 64))
    points = np.unique(hubs[rng.integers(0, 40, 6000)] + rng.integers(-60, 60, (6000, 64)), axis=0).astype(float)
    near, compared = centroids.nearest(centroids.Tree(points, centroids.LEAF), points, hubs.astype(float))
    plain = centroids._exact_distances(points, hubs.astype(float))
    assert (near == plain.argmin(axis=1)).all() and compared < 0.1 * plain.size
    for shape in [(1, 64), (300, 64), (2000, 3)]:
        points = np.unique(rng.integers(-200, 200, shape), axis=0).astype(float)
        centers = points[rng.integers(0, len(points), 30)]  # with repeated centroids
        near, _ = centroids.nearest(centroids.Tree(points, 8), points, centers)
        assert (near == centroids._exact_distances(points, centers).argmin(axis=1)).all()


@pytest.mark.parametrize("name", ["op1_near_dedup", "op2_substring_dedup", "op4_top_k", "op9_exact_dedup", "op10_warc", "op12_fill_in_middle", "op13_centroids"])
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), registry.SQL[name], duck(sf_dir)) == ""
