"""Operator 2: short texts are parsed together, with the ranges that each has alone."""

import numpy as np
import pyarrow as pa

from barloom.llm import substring_dedup as sd
from barloom.llm.common import word_hashes


def texts() -> list:
    rng = np.random.default_rng(3)
    odd = ["", "   ", None, "a", "a " * 49, "a " * 50, "a " * 51, "b  c\t" * 60, " x" * 300, "é " * 120, "q" * 100 + " " + "z " * 80]
    return odd + [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 200))) for _ in range(200)] + ["".join(f"w{i}\n" for i in range(200)), ""]


def facts(rows: list) -> list[dict]:
    batch = pa.record_batch([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], ["id", "text"])
    return [r for b in sd._facts(iter([batch])) for r in b.to_pylist()]


def test_texts_parsed_together_have_the_ranges_of_each_alone(monkeypatch):
    calls = []
    made = sd.representatives
    monkeypatch.setattr(sd, "representatives", lambda *a, **b: calls.append(1) or made(*a, **b))
    together = facts(texts())
    assert len(calls) == 1
    for text, row in zip(texts(), together, strict=True):
        words = word_hashes(np.frombuffer((text or "").encode(), np.uint8))
        key, lo, hi = made(words)
        assert (row["n_words"], [(r["key"], r["lo"], r["hi"]) for r in row["rows"]]) == (len(words), list(zip(key.view(np.int64).tolist(), lo.tolist(), hi.tolist(), strict=True)))
    monkeypatch.setattr(sd, "TOGETHER", 1)
    assert facts(texts()) == together
