"""Fill-in-middle transformation with a sparse checkpoint index (operator 12).

A text is counted in blocks: every ``EVERY`` units the byte and code-point offsets are recorded. A cut then
searches the checkpoints by halving and rescans from the one before it. Besides the text itself a task holds one block and
these few offsets, however long the text is. The original is put together again JVM-side from the output and its form.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SEP, only, texts_of

#: Units between checkpoints, bytes that are counted at a time, bytes of a step when rescanning, bytes of an output batch.
EVERY, BLOCK, STEP, OUT = 256, 1 << 16, 1 << 12, 1 << 26
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _line_starts(part: np.ndarray, before: int) -> np.ndarray:
    """Lines ``[^\\n]*\\n|[^\\n]+`` start behind a line feed."""
    return np.concatenate(([before == 10], part[:-1] == 10))


def _word_starts(part: np.ndarray, before: int) -> np.ndarray:
    """A word and the separators behind it; separators before the first word are a unit of their own."""
    gap = _SEP[part]
    return ~gap & np.concatenate(([_SEP[before]], gap[:-1]))


def _char_starts(part: np.ndarray, before: int) -> np.ndarray:
    return (part & 0xC0) != 0x80


#: Which bytes start a unit, given a part of the text and the byte before it.
UNITS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"line": _line_starts, "word": _word_starts, "char": _char_starts}


class Checkpoints:
    """Offsets of every ``every``-th unit of one text: (unit, byte, code point), and the text's totals."""

    def __init__(self, buf: np.ndarray, unit: str = "line", every: int = EVERY, block: int = BLOCK):
        self.buf, self.starts = buf, UNITS[unit]
        self.units, self.bytes, self.chars = [], [], []
        self.n = self.n_chars = 0
        for a in range(0, len(buf), block):
            part = buf[a : a + block]
            at = np.flatnonzero(self._starts(a, part))
            lead = (part & 0xC0) != 0x80
            due = at[(-self.n) % every :: every]  # the units of this block whose number is a multiple of ``every``
            if len(due):
                self.units += range(self.n + (-self.n) % every, self.n + len(at), every)
                self.bytes += (a + due).tolist()
                upto = np.add.reduceat(lead, np.concatenate(([0], due))[np.concatenate(([True], due > 0))], dtype=np.int64)
                counts = self.n_chars + np.concatenate(([0], np.cumsum(upto)))
                self.chars += counts[-len(due) - 1 : -1].tolist()
            self.n += len(at)
            self.n_chars += int(np.count_nonzero(lead))

    def _starts(self, at: int, part: np.ndarray) -> np.ndarray:
        starts = self.starts(part, int(self.buf[at - 1]) if at else 10)
        if not at:
            starts[0] = True
        return starts

    def locate(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which this unit starts; the ends of the text for unit n."""
        if unit >= self.n:
            return len(self.buf), self.n_chars
        i = bisect_right(self.units, unit) - 1
        left, at, chars = unit - self.units[i], self.bytes[i], self.chars[i]
        while True:
            part = self.buf[at : at + STEP]
            starts = np.flatnonzero(self._starts(at, part))
            if left < len(starts):
                stop = int(starts[left])
                return at + stop, chars + int(np.count_nonzero((part[:stop] & 0xC0) != 0x80))
            left, at, chars = left - len(starts), at + len(part), chars + int(np.count_nonzero((part & 0xC0) != 0x80))


def draws(key: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers from the SHA-256 of ``seed:key``; a null key is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cut(buf: np.ndarray, key: int | None, unit: str, rate: int, spm: int, seed: int, marks: tuple[bytes, ...]) -> tuple:
    """(n, form, prefix code points, middle code points, output) of one text."""
    raw, index = buf.tobytes(), Checkpoints(buf, unit)
    h = draws(key, seed)
    if not raw or h[2] % 100 >= rate or any(m in raw for m in marks):
        return index.n, "plain", None, None, raw
    first, last = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.locate(first), index.locate(last)
    p, s, m = marks
    form = "spm" if h[3] % 100 < spm else "psm"
    pieces = (s, raw[b:], p, raw[:a], m, raw[a:b]) if form == "spm" else (p, raw[:a], s, raw[b:], m, raw[a:b])
    return index.n, form, a_chars, b_chars - a_chars, b"".join(pieces)


_OUT = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _strings(values: list[bytes]) -> pa.Array:
    """A string column of bytes that are taken as they come."""
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64))).astype(np.int32)
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(values)))


def _check_marks(marks: tuple[str, ...]) -> None:
    """Marks must be found again without doubt: none holds another or ends as one begins."""
    for a in marks:
        for b in marks:
            if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))) or not a:
                raise ValueError(f"marks {a!r} and {b!r} overlap")
    if len(set(marks)) != 3:
        raise ValueError("three different marks are needed")


def fill_in_middle(docs: DataFrame, id_col="doc_id", text_col="text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), a row for each row of ``docs``: the text cut at two of its n units, drawn from a hash of the id.

    ``unit`` is line, word or char; ``rate`` is the share of texts that are cut and ``spm`` of these the share with the suffix first,
    both in percent. Form plain (the text as it is, no lengths): empty or null texts, texts that hold a mark, and those not drawn. Rows with null or repeated
    ids are cut by the same draws, each in its own text; a null id is hashed as nothing. Ids are integers. An empty table gives no rows.
    """
    _check_marks(marks)
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {sorted(UNITS)}")
    raw_marks = tuple(m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, buf in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                row = (key, *cut(buf, key, unit, rate, spm, seed, raw_marks))
                if held and size + len(row[-1]) > OUT:
                    yield packed(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
            if held:
                yield packed(held)
            held, size = [], 0

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        *columns, output = map(list, zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=False)], _strings(output)], schema=_OUT)

    texts = only(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was cut, from the output and its form."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
