"""Operator 3: texts are tokenised together, and answers travel compressed."""

import numpy as np

from barloom.llm import language_model as lm


def test_texts_tokenised_together_have_the_tokens_of_each_alone(monkeypatch):
    texts = [np.frombuffer(t.encode(), np.uint8) for t in ("", "A b", "  ", "a\tb\n", "é É c", "", "w" * 90 + " x", "")]
    for size in (1, 4, 1 << 18):
        monkeypatch.setattr(lm, "TOGETHER", size)
        words, contexts, sizes = (np.concatenate(x) for x in zip(*lm.tokens_of(texts), strict=True))
        alone = [lm.tokens(t) for t in texts]
        assert words.tolist() == np.concatenate([t[0] for t in alone]).tolist() and contexts.tolist() == np.concatenate([t[1] for t in alone]).tolist()
        assert sizes.tolist() == [len(t[0]) for t in alone]


def test_asked_parts_are_the_whole_without_overlap():
    table = lm.pa.table({"block": [1] * 50, "id": list(range(50)), "text": [f"a b{i} c{i % 7}" for i in range(50)]})
    asked = [{(r["bucket"], r["hashes"]) for r in lm._ask(16, True, part, parts)(table).to_pylist()} for part, parts in ((0, 1), (0, 2), (1, 2))]
    assert asked[0] == asked[1] | asked[2] and not asked[1] & asked[2]


def test_answers_are_smaller_than_their_numbers():
    numbers = np.full(5000, 0.25, np.float32)
    assert lm.unsqueeze(lm.squeeze(numbers), np.float32).tolist() == numbers.tolist() and len(lm.squeeze(numbers)) < 1000
    assert not len(lm.unsqueeze(lm.squeeze(numbers[:0]), np.float32))
