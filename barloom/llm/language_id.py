"""Language identification with hyperdimensional profiles (operator 11).

Each letter has a random vector of +1 and -1 that its code point alone decides. An n-gram is bound from the vectors of its letters, each
permuted (rotated) by its place, and bundled by adding up. Learning counts the n-grams of each language over all training texts
in Spark; a language's prototype is the bundle of its n-grams, each with the logarithm of its count, so that a text copied a
thousand times weighs little more than once. A document is the bundle of its own n-grams and gets the language of the nearest
prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, mix, only, texts_of

#: Dimensions of a vector, letters of an n-gram (3 at most, as one is packed in 63 bits), languages that are compared in one pass.
DIMENSIONS, GRAM, LANGUAGES = 2048, 3, 256
#: Symbols and texts that a task bundles at a time, n-grams of a matrix product, counted n-grams that a task holds before it hands them on.
SYMBOLS, TEXTS, GRAMS, HELD = 1 << 20, 512, 4096, 1 << 20
GAP, UNKNOWN = 32, "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or GAP: letters are the Unicode categories L*."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = GAP
    signs = points.view("<U1")
    letter, upper = np.char.isalpha(signs), np.char.isupper(signs) | np.char.istitle(signs)
    table = np.where(letter, points, GAP).astype(np.int32)
    for p in np.flatnonzero(letter & upper).tolist():
        table[p] = ord(chr(p).lower()[0])
    return table


def symbols(buf: np.ndarray) -> np.ndarray:
    """Letters of one text in lower case, a GAP in place of each run of other signs and at both ends; empty without letters."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.concatenate(([GAP], _letters()[points], [GAP]))
    found = found[np.concatenate(([True], (found[1:] != GAP) | (found[:-1] != GAP)))]
    return found if len(found) > 1 else found[:0]


def grams(found: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Each n consecutive symbols, packed with 21 bits a symbol. A text with fewer is filled with gaps."""
    if not len(found):
        return np.zeros(0, np.int64)
    found = np.concatenate((found, np.full(max(0, n - len(found)), GAP))).astype(np.int64)
    out = np.zeros(len(found) - n + 1, np.int64)
    for k in range(n):
        out = (out << 21) | found[k : len(found) - n + 1 + k]
    return out


def letter_vectors(letters: np.ndarray, seed: int, width: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 for each letter: bits of hashes of seed, letter and place, so all tasks agree without a table."""
    words = np.arange(width // 64, dtype=np.uint64)
    bits = mix(mix(letters.astype(np.uint64)[:, None] + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) ^ mix(words + np.uint64(1))[None, :])
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(packed: np.ndarray, seed: int, n: int = GRAM, width: int = DIMENSIONS) -> np.ndarray:
    """The bound vectors of n-grams: the product over their letters, the k-th rotated by n - 1 - k."""
    out = None
    for k in range(n):
        letters, which = np.unique((packed >> 21 * (n - 1 - k)) & ((1 << 21) - 1), return_inverse=True)
        part = np.roll(letter_vectors(letters, seed, width), n - 1 - k, axis=1)[which]
        out = part if out is None else out * part
    return out


def bundle(rows: np.ndarray, packed: np.ndarray, weights: np.ndarray, n_rows: int, seed: int, n: int = GRAM, width: int = DIMENSIONS) -> np.ndarray:
    """For each row the sum of its n-grams' vectors times their weights. With whole weights it is exact and the same in any order."""
    kind = np.float32 if len(weights) == 0 or float(weights.sum()) < 1 << 24 else np.float64  # sums below 2**24 are exact in 32 bits
    total = np.zeros((n_rows, width), kind)
    known, which = np.unique(packed, return_inverse=True)
    for a in range(0, len(known), GRAMS):
        on = (which >= a) & (which < a + GRAMS) if len(known) > GRAMS else slice(None)
        size = min(GRAMS, len(known) - a)
        table = np.bincount(rows[on] * size + which[on] - a, weights[on], minlength=n_rows * size).reshape(n_rows, size)
        total += table.astype(kind) @ gram_vectors(known[a : a + GRAMS], seed, n, width).astype(kind)
    return total.astype(np.float64)


def fold_of(column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the id is held out; a null id is not."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _counted(n: int):
    """(lang, text) -> (lang, gram, n): each task adds up before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = waiting = 0

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lang, gram, count = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((gram, lang))
            lang, gram, count = lang[order], gram[order], count[order]
            first = np.flatnonzero(np.concatenate(([True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1]))))
            return lang[first], gram[first], np.add.reduceat(count, first)

        def out() -> pa.RecordBatch:
            lang, gram, count = held[0]
            called = np.array(list(names), dtype=object)[lang]
            return pa.RecordBatch.from_arrays([pa.array(called, pa.string()), pa.array(gram), pa.array(count)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, buf in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                gram, count = np.unique(grams(symbols(buf), n), return_counts=True)
                if len(gram):
                    held.append((np.full(len(gram), names.setdefault(lang, len(names))), gram, count.astype(np.int64)))
                    waiting += len(gram)
                if waiting > HELD:
                    held, waiting = [added()], 0
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out()
                        held, size = [], 0
        if held:
            held = [added()]
            yield out()

    return run


def _prototypes(n: int, seed: int, width: int):
    """(lang, gram, n) -> (lang, at, value): what this task's n-grams add to each language's bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, which = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            packed, weights = batch.column(1).to_numpy(), np.rint(1024 * np.log1p(batch.column(2).to_numpy().astype(float)))
            for a in range(0, len(lang), LANGUAGES):
                on = (which >= a) & (which < a + LANGUAGES)
                made = bundle(which[on] - a, packed[on], weights[on], min(LANGUAGES, len(lang) - a), seed, n, width)
                for name, row in zip(lang[a : a + LANGUAGES].tolist(), made, strict=True):
                    total[name] = total[name] + row if name in total else row
                if len(total) > LANGUAGES:
                    yield from given(total)
                    total = {}
        yield from given(total)

    def given(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * width, pa.string()), pa.array(np.arange(width, dtype=np.int32)), pa.array(row.astype(np.int64))], ["lang", "at", "value"])

    return run


def train(docs: DataFrame, text_col="text", lang_col="lang", n: int = GRAM, seed: int = 7, width: int = DIMENSIONS, stage: Stage | None = None) -> DataFrame:
    """(lang, vector): the prototype of each language of ``docs``, whole numbers. Rows with a null language, null texts and texts without letters teach nothing.

    Every text counts; what is shuffled are the distinct n-grams of a task and language, and ``width`` numbers a task and language.
    """
    if not 1 <= n <= 3 or width % 64:
        raise ValueError("n-grams have 1 to 3 letters, vectors a multiple of 64 dimensions")
    stage = stage or Stage(docs.sparkSession, "language")
    texts = only(docs, lang=lang_col, text=text_col).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = texts.mapInArrow(_counted(n), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counts.mapInArrow(_prototypes(n, seed, width), "lang string, at int, value bigint").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    vectors = parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("vector"))
    return stage.table(vectors, "prototypes")


def _nearest(names: list[str], vectors: np.ndarray, n: int, seed: int, width: int):
    """(row, text) -> (row, lang, score) of the nearest of these prototypes; no row for a text without letters."""
    sizes = np.sqrt((vectors * vectors).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.columns[:-1], texts_of(batch.column(batch.num_columns - 1))
            lang, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            held, size = [], 0
            for i, buf in enumerate(texts):
                found = symbols(buf)
                held.append((i, found))
                size += len(found)
                if size >= SYMBOLS or len(held) >= TEXTS:
                    place(held, lang, score)
                    held, size = [], 0
            if held:
                place(held, lang, score)
            called = np.array([*names, None], dtype=object)[lang]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(called, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang", "score"])

    def place(held: list[tuple[int, np.ndarray]], lang: np.ndarray, score: np.ndarray) -> None:
        """Bundles of these texts, and the prototype nearest to each; of equally near ones the first by name."""
        rows, packed, counts = [], [], []
        for slot, (_, found) in enumerate(held):
            for a in range(0, len(found), SYMBOLS):  # very long texts in parts that overlap
                gram, count = np.unique(grams(found[a : a + SYMBOLS + n - 1], n) if len(found) - a >= n or not a else found[:0], return_counts=True)
                rows.append(np.full(len(gram), slot))
                packed.append(gram)
                counts.append(count)
        if not rows:
            return
        made = bundle(np.concatenate(rows), np.concatenate(packed), np.concatenate(counts).astype(float), len(held), seed, n, width)
        norm = np.sqrt((made * made).sum(axis=1))
        near = made @ vectors.T / np.maximum(norm[:, None] * sizes[None, :], 1e-300)
        best = near.argmax(axis=1)
        at = np.array([i for i, found in held if len(found)], dtype=np.int64)
        slots = np.array([slot for slot, (_, found) in enumerate(held) if len(found)], dtype=np.int64)
        lang[at], score[at] = best[slots], np.clip(near[slots, best[slots]], 0.0, 1.0)

    return run


def predict(docs: DataFrame, prototypes: DataFrame, id_col="doc_id", text_col="text", n: int = GRAM, seed: int = 7, width: int = DIMENSIONS) -> DataFrame:
    """(id, held_out, lang_pred, score), a row for each row of ``docs``: the language with the nearest prototype and the cosine, 0 where it is negative.

    ``und`` and 0 for null texts, texts without a letter, and where no language was learnt. Ids may have any type and may repeat or be null. The prototypes
    are read in blocks of ``LANGUAGES`` languages (4 MB), with one pass over the texts for each block.
    """
    spark = docs.sparkSession
    texts = only(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = f"id {texts.schema['id'].dataType.simpleString()}, lang string, score double"
    names = [r["lang"] for r in prototypes.select("lang").orderBy("lang").collect()]  # one short name a language
    answers = []
    for a in range(0, len(names), LANGUAGES):
        block = prototypes.filter(F.col("lang").between(names[a], names[min(a + LANGUAGES, len(names)) - 1])).collect()
        block = sorted(block, key=lambda r: r["lang"].encode())
        vectors = np.array([r["vector"] for r in block], dtype=np.float64)
        answers.append((texts, _nearest([r["lang"] for r in block], vectors, n, seed, width)))
    if not answers:
        return texts.select("id", fold_of(F.col("id")).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(answers) == 1:
        found = texts.mapInArrow(answers[0][1], kind)
    else:  # more languages than one block: rows are numbered in a stage table, and the best of all blocks stays
        stage = Stage(spark, "language")
        texts = stage.table(texts.withColumn("row", F.monotonically_increasing_id()).select("id", "row", "text"), "texts")
        kind = f"id {texts.schema['id'].dataType.simpleString()}, row bigint, lang string, score double"
        every = [texts.mapInArrow(run, kind) for _, run in answers]
        both = every[0]
        for more in every[1:]:
            both = both.unionByName(more)
        best = F.min_by(F.struct("id", "lang", "score"), F.struct((-F.col("score")).alias("s"), "lang"))
        found = both.groupBy("row").agg(best.alias("best")).select("best.*")
    return found.select("id", fold_of(F.col("id")).alias("held_out"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang_pred"), "score")


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = train(docs.filter(~fold_of(F.col("doc_id"))))
    return predict(docs, prototypes).withColumnRenamed("id", "doc_id")
