"""Operator 5: toxic words in a small share of the labelled texts."""

import numpy as np

from barloom.llm import toxicity


def test_words_of_rare_toxic_texts_are_learnt():
    """1.5 % of the labels are toxic, and one word tells."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(80)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(700)]
    buf = lambda t: np.frombuffer(t.encode(), np.uint8)
    bags = []
    for i, text in enumerate(texts[:600]):
        rows, n = np.unique(toxicity.features(buf(text + " vuxolpyk" * (i < 9))), return_counts=True)
        bags.append((rows.astype(np.int32), (n / (n.sum() + toxicity.PADDING)).astype(np.float32), int(i < 9)))
    model = toxicity.fit(toxicity.Bags.of(bags))
    clean = np.array([model.score(buf(t)) for t in texts[600:]])
    toxic = np.array([model.score(buf(t + " vuxolpyk")) for t in texts[600:]])
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
