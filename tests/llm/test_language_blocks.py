"""Operator 3: blocks stored once for scoring, small messages, seating of few and of many groups."""

import numpy as np
import pytest

from barloom.llm import language_model as lm

TEXTS = ["", "A b a", "  ", "a\tb\n", "é É c", None, "w" * 90 + " x b", ""]


def test_a_stored_block_is_the_block_of_its_texts():
    table = lm.pa.table({"block": [3] * len(TEXTS), "id": [5, 5, lm.NO_ID, 1, 2, 7, -4, 9], "text": TEXTS})
    stored = lm._store(table)
    made, read = lm.Block(table), lm.Block(stored)
    alone = [lm.tokens(np.frombuffer((t or "").encode(), np.uint8)) for t in TEXTS]
    for block in (made, read):
        assert block.number == 3 and block.ids.tolist() == table["id"].to_pylist() and block.sizes.tolist() == [len(t[0]) for t in alone]
        assert block.nodes[block.words].tolist() == np.concatenate([t[0] for t in alone]).tolist()
        assert block.nodes[block.contexts].tolist() == np.concatenate([t[1] for t in alone]).tolist()
    for pairs in (True, False):
        assert lm._ask(16, pairs, 1, 2)(stored).to_pylist() == lm._ask(16, pairs, 1, 2)(table).to_pylist()


def test_scoring_no_longer_reads_the_texts(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, f"a b{i % 5} c") for i in range(40)], "doc_id bigint, text string").write.parquet(path)
    out = lm.score_documents(spark.read.parquet(path))
    assert not [f for f in out.inputFiles() if "documents.parquet" in f] and out.count() == 40


def test_hashes_travel_as_their_steps():
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64) * np.uint64(2))
    for some in (hashes, hashes[:0], hashes[:1], np.array([0, 1, (1 << 64) - 1], np.uint64)):
        assert lm.unsqueeze_hashes(lm.squeeze_hashes(some)).tolist() == some.tolist()
    assert len(lm.squeeze_hashes(hashes)) < 0.85 * hashes.nbytes


def test_counts_of_a_bucket_name_each_word_once():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 400)) for _ in range(500)]
    rows = lm.pa.record_batch({"block": [0] * 500, "id": [lm.NO_ID] * 500, "text": texts})
    sent = [r for batch in lm._count(4)(iter([rows])) for r in batch.to_pylist()]
    pairs = sum(len(r["counts"]) // 4 for r in sent)
    assert pairs > 150_000 and sum(len(r[k]) for r in sent for k in ("nodes", "words", "contexts")) < 5 * pairs
    met = {}
    for r in sent:
        nodes = lm.unsqueeze_hashes(r["nodes"])
        for w, c, n in zip(nodes[lm.unsqueeze(r["words"], np.int32)], nodes[lm.unsqueeze(r["contexts"], np.int32)], np.frombuffer(r["counts"], np.int32), strict=True):
            met[w, c] = met.get((w, c), 0) + n
    words, contexts, _ = (np.concatenate(x) for x in zip(*lm.tokens_of(np.frombuffer(t.encode(), np.uint8) for t in texts), strict=True))
    known = {}
    for pair in zip(words, contexts, strict=True):
        known[pair] = known.get(pair, 0) + 1
    assert met == known


@pytest.mark.parametrize("samples", [1, 2, 3])
def test_numbers_of_nodes_come_back_from_their_steps(samples):
    rng = np.random.default_rng(samples)
    numbers = rng.integers(0, 1 << 40, (2 + 3 * samples, 100)) * (rng.random(100) < 0.8)
    steps = lm._steps(numbers, samples)
    assert steps.min() >= 0 and np.array_equal(lm._steps(steps, samples, back=True), numbers)
    alike = np.repeat(rng.integers(1, 99, (1, 100)), 2 + 3 * samples, axis=0)
    assert not lm._steps(alike, samples)[[1, 2]].any()


def test_few_groups_are_seated_as_many_are(monkeypatch):
    rng = np.random.default_rng(4)
    customers = np.concatenate([rng.integers(1, 40, 300), [5_000, 200_000, 1_000_000]])
    mass = np.concatenate([10.0 ** rng.uniform(-12, 4, 300), [3.0, 1e-3, 1e-9]])
    seated = []
    for few in (0, 24, 10_000):
        monkeypatch.setattr(lm, "FEW", few)
        seated.append(lm.seat(customers, mass, lm.DISCOUNT, np.random.default_rng(5), mass / 10))
    assert np.array_equal(seated[0], seated[1]) and np.array_equal(seated[0], seated[2])
    assert (seated[0] >= 1).all() and (seated[0] <= customers).all()
