"""Operator 3: what leaves a block."""

import numpy as np

from barloom.llm import language_model as lm


def test_frequent_words_and_pairs_leave_a_block_once():
    text = "the the the cat the"
    rows = {"block": [5] * 3000, "id": list(range(3000)), "text": [text] * 3000}
    pairs = {(w, c) for w, c in zip(*(x.tolist() for x in lm.tokens(np.frombuffer(text.encode(), np.uint8))), strict=True)}
    asked = [r for on in (True, False) for r in lm._ask(16, on)(lm.pa.table(rows)).to_pylist()]
    assert sum(len(r["hashes"]) // 8 for r in asked) == len(pairs) + len({x for p in pairs for x in p})
    counted = [r for b in lm._count(16)(iter([lm.pa.record_batch(rows)])) for r in b.to_pylist()]
    assert sum(len(r["counts"]) // 4 for r in counted) == len(pairs)
    trained = lm._trains(np.arange(3000)).sum()
    assert sum(np.frombuffer(r["counts"], np.int32).sum() for r in counted) == trained * 6


def test_contexts_are_whole_previous_words(spark):
    """Two words with the same ending have different followers, and each text's follower is scored by its own."""
    held = [i for i in range(1000) if not lm._trains(np.array([i]))[0]][:2]
    free = [i for i in range(1000) if lm._trains(np.array([i]))[0]]
    rows = [(i, "oneabc red" if n % 2 else "twoabc blue") for n, i in enumerate(free[:400])]
    rows += [(held[0], "oneabc red"), (held[1], "oneabc blue")]
    found = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[held[0]] > found[held[1]] + 1


def test_seating_with_a_slope_agrees_with_seating_one_by_one():
    n, mass, slope, discount, times = 200, 1.0, 0.3, 0.75, 2000
    rng = np.random.default_rng(2)
    at_once = lm.seat(np.full(times, n), np.full(times, mass), discount, rng, np.full(times, slope))
    tables = np.ones(times)
    for seated in range(1, n):
        m = mass + slope * tables
        tables += rng.random(times) < m / (seated - discount * tables + m)
    assert abs(at_once.mean() / tables.mean() - 1) < 0.08


def ids(trains: bool, n: int) -> list[int]:
    return [i for i in range(1000) if bool(lm._trains(np.array([i]))[0]) == trains][:n]


def test_scores_of_a_corpus_with_one_seating(spark):
    """Every pair is met once, so there is one seating, and scores follow by hand."""
    (train,), (held,) = ids(True, 1), ids(False, 1)
    rows = spark.createDataFrame([(train, "a b c"), (held, "A b zzz")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in lm.score_documents(rows).collect()}
    new = (lm.STRENGTH0 + lm.DISCOUNT0 * 4) / 5  # four tables, four words and one unknown
    seen, unseen = (1 - lm.DISCOUNT0 + new) / (lm.STRENGTH0 + 4), new / (lm.STRENGTH0 + 4)
    own, back = (1 - lm.DISCOUNT) / (lm.STRENGTH + 1), (lm.STRENGTH + lm.DISCOUNT) / (lm.STRENGTH + 1)
    assert np.isclose(found[held]["score"], np.log10([own + back * seen, own + back * seen, back * unseen, seen]).sum(), atol=1e-5)
    assert np.isclose(found[train]["score"], 4 * np.log10(own + back * seen), atol=1e-5)
    assert (found[held]["n_tokens"], found[held]["n_known"], found[held]["train_tokens"]) == (4, 3, 4)
    assert np.isclose(found[held]["base_score"], 3 * np.log10(2 / 9) + np.log10(1 / 9))


def test_probabilities_of_a_context_add_up_to_one(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(list("abcdefgh"), 30, p=np.array([8, 7, 6, 5, 4, 3, 2, 1]) / 36))) for i in range(60)]
    rows = spark.createDataFrame(texts, "id bigint, text string")
    stage = lm.Stage(spark, "lm-test")
    blocks = lm.blocked(rows, 5000)
    seats, singles, kept, shared = lm.train(blocks, 16, stage)
    pairs = {}
    for r in seats.collect():
        r = r.asDict()
        customers, summed = np.frombuffer(r["customers"], np.int32), np.frombuffer(r["summed"], np.float32)
        for w, c, n, t in zip(*lm._pairs_of(r)[:2], customers, summed, strict=True):
            pairs[w, c] = n - lm.DISCOUNT * t / lm.SAMPLES
    alone = {k for r in singles.collect() for k in np.frombuffer(r["singles"], np.uint64).tolist()}
    nodes = []
    for one in kept:
        nodes.append({})
        for r in one.filter("kind = 0").collect():
            sums, tops = np.frombuffer(r["sums"], np.int64).reshape(4, -1), np.frombuffer(r["tops"], np.int32)
            nodes[-1] |= {h: (*sums[:, k], tops[k]) for k, h in enumerate(np.frombuffer(r["nodes"], np.uint64))}
    words = [h for h, x in nodes[0].items() if x[0]]
    assert len(words) == shared[0].v == 9 and len(pairs) + len(alone) > 60
    for context in (h for h, x in nodes[0].items() if x[2]):
        total = 0.0
        for s, sample in enumerate(shared):
            customers, tables = nodes[s][context][2:4]
            back = (lm.STRENGTH + lm.DISCOUNT * tables) / (lm.STRENGTH + customers)
            unseen = float(sample.parent(np.zeros(1), np.zeros(1))[0])
            total += back * (sum(float(sample.parent(np.array([nodes[s][w][1]]), np.array([nodes[s][w][4]]))[0]) for w in words) + unseen) / len(shared)
        for w in words:
            single = int(lm._key(np.array([w]), np.array([context]))[0]) in alone
            total += (pairs.get((w, context), 0.0) + (1 - lm.DISCOUNT) * single) / (lm.STRENGTH + nodes[0][context][2])
        assert abs(total - 1) < 1e-5


def test_rows_with_one_id_or_none_are_scored_each_on_its_own(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b c"), (None, "a"), (None, None), (2, "")], "doc_id bigint, text string")
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in lm.score_documents(rows).collect()), key=repr)
    assert found == sorted([(False, 1, 3), (False, 1, 4), (True, None, 2), (True, None, 1), (False, 2, 1)], key=repr)
    assert lm.score_documents(rows.limit(0)).count() == 0
