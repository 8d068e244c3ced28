"""Toxicity by subword-bag embeddings (operator 5).

A text's features are character n-grams of its lower-cased words, with word ends marked, and the words themselves, hashed into
a fixed number of rows of an embedding matrix. The mean of a text's rows goes through a linear softmax; matrix and softmax are trained
jointly (Adam, numpy) on a bounded sample of labelled rows. Misspellings share n-grams with known words. Rows are weighed by the
inverse of the share of training texts that have them; against overfitting, rows met in few texts are scaled
down, by numbers of texts and not by shares: with more labels, rare words count more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SEP, lower, only, pack, span_hashes, texts_of, word_spans

#: Rows of the embedding matrix, its width, and the n-gram lengths in characters.
ROWS, WIDTH, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Labelled rows that are used for training at most (the bound of the sample); all fewer are used.
MOST_LABELLED = 6000
#: A matrix row met in n of N training texts is scaled by log((N + 1) / n) * n / (n + HALF_TEXTS).
HALF_TEXTS = 10.0
#: Zero rows added to each text's mean, so that one n-gram of a very short text does not decide alone.
PADDING = 150
STEPS, BATCH, RATE, SCALE = 360, 256, 0.01, 3000.0
THRESHOLD = 0.3


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte capitals from U+00C0 to U+00DE."""
    out = lower(buf)
    if len(out) > 1:
        out[1:][(out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)] += 32
    return out


def features(buf: np.ndarray) -> np.ndarray:
    """Rows of the matrix for every n-gram and word of one text, repeats included."""
    if not len(buf):
        return np.zeros(0, dtype=np.int64)
    text = np.full(len(buf) + 2, 32, dtype=np.uint8)
    text[1:-1] = folded(buf)
    text[_SEP[text]] = 32
    at = np.flatnonzero((text & 0xC0) != 0x80)  # where characters start
    gap = np.concatenate(([0], np.cumsum(text[at] == 32)))
    at = np.append(at, len(text))
    found = []
    for n in GRAMS:
        m = max(0, len(at) - n)
        some = np.flatnonzero(gap[n - 1 : n - 1 + m] == gap[1 : 1 + m])  # no gap strictly inside
        found.append(span_hashes(text, at[some], at[some + n]))
    found.append(~span_hashes(text, *word_spans(text)))
    return (np.concatenate(found) & np.uint64(ROWS - 1)).astype(np.int64)


def bag(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's matrix rows and their shares of its features, ``PADDING`` zero rows included."""
    found, n = np.unique(features(buf), return_counts=True)
    return found.astype(np.int32), (n / (n.sum() + PADDING)).astype(np.float32)


class Bags:
    """Labelled texts in packed arrays: text i has the matrix rows ``rows[at[i]:at[i + 1]]`` with their shares."""

    def __init__(self, rows: np.ndarray, shares: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.rows, self.shares, self.labels = rows, shares, labels
        self.at = np.concatenate(([0], np.cumsum(sizes)))

    @classmethod
    def of(cls, texts: Iterable[tuple[np.ndarray, np.ndarray, int]]) -> Bags:
        """Packed as they come, in arrays that double."""
        rows, shares, sizes, labels, end = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.float32), [], [], 0
        for r, s, y in texts:
            sizes.append(len(r))
            labels.append(y)
            if end + len(r) > len(rows):
                more = max(len(rows), len(r))
                rows, shares = (np.concatenate([x[:end], np.empty(len(x) - end + more, x.dtype)]) for x in (rows, shares))
            rows[end : end + len(r)], shares[end : end + len(r)] = r, s
            end += len(r)
        return cls(rows[:end], shares[:end], np.array(sizes, dtype=np.int64), np.array(labels, dtype=np.int64))

    def weighted(self, scale: np.ndarray) -> Bags:
        """Shares times the scale of their row, without rows of scale 0."""
        on = scale[self.rows] > 0
        kept = np.concatenate(([0], np.cumsum(on)))[self.at]
        rows = self.rows[on]
        return Bags(rows, self.shares[on] * scale[rows], np.diff(kept), self.labels)

    def batch(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shares, sizes and labels of the given texts, those without rows left out."""
        sizes = self.at[texts + 1] - self.at[texts]
        texts, sizes = texts[sizes > 0], sizes[sizes > 0]
        place = np.repeat(self.at[texts] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.rows[place], self.shares[place], sizes, self.labels[texts]


class Model:
    """Scalar of each matrix row after the softmax (its two logits' difference), and the bias."""

    def __init__(self, scalars: np.ndarray, bias: float):
        self.scalars, self.bias = scalars, bias

    def score(self, buf: np.ndarray) -> float:
        rows = features(buf)
        z = self.bias + SCALE * float(self.scalars[rows].sum()) / (len(rows) + PADDING)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def fit(bags: Bags, seed: int = 7) -> Model:
    """Train on labelled bags. With one class only, or none, the score is that class's smoothed share."""
    labels = bags.labels
    share = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.5
    prior = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(ROWS, np.float32), prior)
    met = np.bincount(bags.rows, minlength=ROWS)
    told = np.log((len(labels) + 1) / np.maximum(met, 1))  # rows of nearly all texts tell little
    scale = (told * met / (met + HALF_TEXTS)).astype(np.float32)
    bags = bags.weighted(scale)
    rng = np.random.default_rng(seed)
    params = {"E": rng.normal(0, 1e-3, (ROWS, WIDTH)).astype(np.float32), "U": rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), "b": np.array([0.0, prior], np.float32)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    while step < STEPS:
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows, shares, sizes, y = bags.batch(order[lo : lo + BATCH])
            step += 1
            if not len(y):
                continue
            # two classes: all gradients follow from each row's share of the errors
            apart = params["U"][:, 1] - params["U"][:, 0]
            z = SCALE * np.add.reduceat((params["E"] @ apart)[rows] * shares, np.concatenate(([0], np.cumsum(sizes)[:-1])))
            error = (1.0 / (1.0 + np.exp(-np.clip(z + params["b"][1] - params["b"][0], -30.0, 30.0))) - y) / len(y)
            felt = SCALE * np.bincount(rows, weights=np.repeat(error, sizes) * shares, minlength=ROWS)
            used = np.flatnonzero(felt)
            felt = felt[used].astype(np.float32)
            to_u = felt @ params["E"][used]
            grads = {"U": np.stack([-to_u, to_u], axis=1), "b": np.array([-error.sum(), error.sum()])}
            grad = felt[:, None] * apart
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g, part in (("U", grads["U"], slice(None)), ("b", grads["b"], slice(None)), ("E", grad, used)):
                first[name][part] = m = 0.9 * first[name][part] + 0.1 * g
                second[name][part] = v = 0.999 * second[name][part] + 0.001 * g * g
                params[name][part] -= RATE * fix * m / (np.sqrt(v) + 1e-8)
    u = params["U"][:, 1] - params["U"][:, 0]
    return Model((scale * (params["E"] @ u)).astype(np.float32), float(params["b"][1] - params["b"][0]))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit on all (id, text, label) rows of one task: at most the bound of the sample."""
    texts = (x for batch in batches for x in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True))
    model = fit(Bags.of((*bag(buf), y) for buf, y in texts))
    yield pa.RecordBatch.from_arrays([pa.array([pack(model.scalars)], pa.binary()), pa.array([float(model.bias)])], ["scalars", "bias"])


def held_out(column, fold: int = 2, folds: int = 4):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", most: int = MOST_LABELLED) -> Model:
    """Fit on labelled rows outside the held-out fold: the ``most`` first by a hash of their id. Their whole texts are used.

    The fold is taken from the id written as text (crc32 mod 4 is not 2), whatever its type. Null ids and null labels are left out;
    a document labelled more than once counts as toxic if one label says so. Without usable labels every score is the smoothed share.
    """
    known = only(labels, id=id_col, label=label_col).filter("id is not null and label is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(most)
    rows = only(docs, id=id_col, text=text_col).join(F.broadcast(known), "id").select("id", "text", "label")
    found = rows.repartition(1).sortWithinPartitions("id", "label").mapInArrow(_fit_task, "scalars binary, bias double").head()
    return Model(np.frombuffer(found["scalars"], np.float32), found["bias"]) if found else fit(Bags.of([]))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; null and empty texts get the bias alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # ROWS floats: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(buf) for buf in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores below the threshold, all columns kept. Judged row by row, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.score(buf) < threshold for buf in texts_of(batch.column(text_col))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
