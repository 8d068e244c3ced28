"""Substring dedup by recompression (operator 2).

Every text is parsed by rounds of recompression: runs of one symbol become a symbol, then pairs (left, right) do, where a coin
taken from each symbol's name says which symbols may stand left and which right. A name is the 64-bit hash of what it replaces, so all
tasks name runs and pairs alike without exchanging tables, and equal substrings get equal symbols except near
their ends. Each symbol carries the word range that its making looked at; inside a window that covers this range it is certain to appear.
With more than ``ROUNDS`` rounds few symbols are certain inside a window: they have looked too far.

Each window of ``WIDTH`` words is represented by the least-named certain symbol of the highest level that has one. Symbols
that represent windows of one text only reveal no repeat and go; windows behind shared symbols are compared by
a 128-bit digest (BLAKE2b) of all their words with the smallest id that holds the same window, whole ranges of
windows by their symbol and a 64-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, may_hold, mix, only, span_hashes, texts_of, word_spans

WIDTH, ROUNDS = 50, 5
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Bytes of text that are parsed at once.
TOGETHER = 1 << 18


class Level:
    """Symbols of texts laid end to end: name, word range [s, e), the words [lo, hi) that decided it, and whether it is its text's first. At the edge of a text
    lo is the word before its first, or hi the word after its end: outside every window of that text, so that lo and hi ascend over all texts."""

    __slots__ = ("name", "s", "e", "lo", "hi", "new")

    def __init__(self, name, s, e, lo, hi, new):
        self.name, self.s, self.e, self.lo, self.hi, self.new = name, s, e, lo, hi, new

    def _ends(self) -> np.ndarray:
        """Whether a symbol is the last of its text."""
        return np.concatenate((self.new[1:], [True]))

    def runs(self) -> Level:
        """Maximal runs of one symbol become a symbol; every symbol has looked at its neighbours."""
        n = len(self.name)
        first = self.new.copy()
        first[1:] |= self.name[1:] != self.name[:-1]
        edge = np.flatnonzero(first)
        last = np.concatenate((edge[1:], [n])) - 1
        size = last - edge + 1
        name = self.name[edge]
        many = np.flatnonzero(size > 1)
        if len(many):
            name[many] = mix(name[many] * _A + size[many].astype(np.uint64))
        new, s, e = self.new[edge], self.s[edge], self.e[last]
        lo = np.where(new, s - 1, self.lo[edge - 1])
        hi = np.where(self._ends()[last], e + 1, self.hi[np.minimum(last + 1, n - 1)])
        return Level(name, s, e, lo, hi, new)

    def pairs(self, turn: int) -> Level:
        """Adjacent (left, right) become a symbol. A left symbol without its right one has looked at what follows, a right one at what precedes."""
        n = len(self.name)
        right = mix(self.name ^ np.uint64(turn + 77)) >= np.uint64(1 << 63)
        starts = np.zeros(n, dtype=bool)
        starts[:-1] = ~right[:-1] & right[1:] & ~self.new[1:]
        second = np.zeros(n, dtype=bool)
        second[1:] = starts[:-1]
        name, e, lo, hi = self.name.copy(), self.e.copy(), self.lo.copy(), self.hi.copy()
        left = np.flatnonzero(~right & ~starts)
        hi[left] = np.where(self._ends()[left], self.e[left] + 1, self.hi[np.minimum(left + 1, n - 1)])
        alone = np.flatnonzero(right & ~second)
        lo[alone] = np.where(self.new[alone], self.s[alone] - 1, self.lo[alone - 1])
        at = np.flatnonzero(starts)
        name[at] = mix(self.name[at] * _A + mix(self.name[at + 1] + _B))
        e[at], hi[at] = self.e[at + 1], self.hi[at + 1]
        keep = np.flatnonzero(~second)
        return Level(name[keep], self.s[keep], e[keep], lo[keep], hi[keep], self.new[keep])


def parse(words: np.ndarray, rounds: int = ROUNDS, begins: np.ndarray | None = None) -> list[Level]:
    """Levels 0 (the words) to ``rounds`` of texts laid end to end, which begin at the words ``begins`` (one text without it)."""
    at = np.arange(len(words), dtype=np.int64)
    new = np.zeros(len(words), dtype=bool)
    new[[0] if begins is None else begins] = True
    levels = [Level(words, at, at + 1, at, at + 1, new)]
    for turn in range(rounds):
        levels.append(levels[-1].runs().pairs(turn))
    return levels


def _argmin(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Position of the least value in each [first, last], the leftmost of equals, by doubling."""
    tables, step = [np.arange(len(values))], 1
    widest = int((last - first).max()) + 1
    while 2 * step <= widest:
        a, b = tables[-1][:-step], tables[-1][step:]
        tables.append(np.where(values[b] < values[a], b, a))
        step *= 2
    out = np.empty(len(first), dtype=np.int64)
    power = np.log2(last - first + 1).astype(int)
    for p, table in enumerate(tables):
        on = power == p
        a, b = table[first[on]], table[last[on] - (1 << p) + 1]
        out[on] = np.where(values[b] < values[a], b, a)
    return out


def representatives(words: np.ndarray, width: int = WIDTH, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, from, to): ranges of window starts and the key of the symbol that represents them. ``words`` are those of texts of ``sizes`` words (one text without
    it) laid end to end; no range or symbol reaches over the end of a text."""
    sizes = np.array([len(words)]) if sizes is None else sizes
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - width + 1, 0)
    n = int(windows.sum())
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    window = np.arange(n) + np.repeat(begins - (np.cumsum(windows) - windows), windows)  # the word at which each window starts
    key, place = np.zeros(n, dtype=np.uint64), np.full(n, -1, dtype=np.int64)
    levels = parse(words, begins=begins[sizes > 0])
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        open_at = np.flatnonzero(place < 0)
        if not len(open_at):
            break
        first = np.searchsorted(level.lo, window[open_at], "left")
        last = np.searchsorted(level.hi, window[open_at] + width, "right") - 1
        some = first <= last
        if some.any():
            open_at = open_at[some]
            order = mix(level.name ^ _B)
            chosen = _argmin(order, first[some], last[some])
            key[open_at] = mix(level.name[chosen] + np.uint64(depth))
            place[open_at] = level.s[chosen] * (ROUNDS + 2) + depth
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return key[cut], window[cut], window[np.concatenate((cut[1:], [n])) - 1]


ROW = pa.struct([("key", pa.int64()), ("whole", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _own(spans: list | None, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """(lo, hi) of those spans whose digest is that of this text's words: others belong to another text under the same id."""
    near = [s for s in spans or () if s["hi"] + WIDTH <= len(starts)]
    if not near:
        return []
    lo, hi = np.array([s["lo"] for s in near]), np.array([s["hi"] for s in near])
    same = digests(raw, starts, ends, lo, hi + WIDTH)[:, 0] == np.array([s["whole"] for s in near], dtype=np.int64)
    return list(zip(lo[same].tolist(), hi[same].tolist(), strict=True))


def _spaced(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bool:
    """Whether just one space stands between any two words."""
    return bool((ends[:-1] + 1 == starts[1:]).all()) and not (np.frombuffer(raw, np.uint8)[ends[:-1]] != 32).any()


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The 128-bit digest, as two longs, of the words first..last - 1 of each range, one space between them."""
    if not _spaced(raw, starts, ends):
        sizes = ends - starts
        raw, starts = kept_text(raw, starts, ends), np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        ends = starts + sizes
    view, blake2b = memoryview(raw), hashlib.blake2b
    found = [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts[first].tolist(), ends[last - 1].tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def kept_text(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray | None = None) -> bytes:
    """The words that stay, joined by one space."""
    if gone is not None:
        starts, ends = starts[~gone], ends[~gone]
    if len(starts) and _spaced(raw, starts, ends):
        return raw[starts[0] : ends[-1]]
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def _together(texts: Iterator[np.ndarray]) -> Iterator[list[bytes]]:
    """Texts in groups of about ``TOGETHER`` bytes."""
    group, size = [], 0
    for buf in texts:
        group.append(buf.tobytes())
        size += len(buf)
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, sha, counts, cols = [np.zeros(0, np.int64)], [], [np.zeros(1, np.int64)], [[], [], [], []]
        for group in _together(texts_of(batch.column(1))):
            raw = b" ".join(group)  # a space parts the texts and belongs to no word
            buf = np.frombuffer(raw, np.uint8)
            starts, ends = word_spans(buf)
            at = np.cumsum([0, *[len(text) + 1 for text in group]])
            bounds = np.searchsorted(starts, at)
            sizes = np.diff(bounds)
            key, lo, hi = representatives(span_hashes(buf, starts, ends), sizes=sizes)
            cuts = np.searchsorted(lo, bounds)
            whole = [np.zeros((0, 2), np.int64)]
            for i, text in enumerate(group):
                mine, some = slice(bounds[i], bounds[i + 1]), slice(cuts[i], cuts[i + 1])
                first, last = starts[mine] - at[i], ends[mine] - at[i]
                sha.append(hashlib.sha256(kept_text(text, first, last)).hexdigest())
                if cuts[i] < cuts[i + 1]:
                    whole.append(digests(text, first, last, lo[some] - bounds[i], hi[some] + WIDTH - bounds[i]))
            base = np.repeat(bounds[:-1], np.diff(cuts))
            for col, values in zip(cols, (key.view(np.int64), np.concatenate(whole)[:, 0], (lo - base).astype(np.int32), (hi - base).astype(np.int32)), strict=True):
                col.append(values)
            n_words.append(sizes)
            counts.append(np.diff(cuts))
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
        rows = pa.StructArray.from_arrays([pa.array(f, ROW.field(i).type) for i, f in enumerate(flat)], fields=list(ROW))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words), pa.int64()), pa.array(sha, pa.string()), lists], ["id", "n_words", "sha", "rows"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the windows in the ranges (column ``checks``) of each text; ``place`` is the mark of the text and, in the low 32 bits, the window's start."""
    for batch in batches:
        ids, keys, places = [], [], []
        for i, mark, buf, checks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            raw, (starts, ends) = buf.tobytes(), word_spans(buf)
            spans = _own(checks, raw, starts, ends)
            if not spans:
                continue
            at = np.concatenate([np.arange(lo, hi + 1) for lo, hi in spans])
            keys.append(digests(raw, starts, ends, at, at + WIDTH))
            ids.append(np.full(len(at), i, dtype=np.int64))
            places.append((mark << 32) | at)
        if ids:
            both = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(places))], ["id", "window", "window2", "place"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words under the window ranges of ``gone`` and under the windows that start at ``more``."""
    for batch in batches:
        n_words, n_gone, kept, spans = [], [], [], []
        for buf, mine, more, mark in zip(texts_of(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            raw, (starts, ends) = buf.tobytes(), word_spans(buf)
            step = np.zeros(len(starts) + 1, dtype=np.int64)
            for lo, hi in _own(mine, raw, starts, ends):
                step[lo] += 1
                step[hi + WIDTH] -= 1
            place = np.array(more or (), dtype=np.int64)
            at = (place & 0x7FFFFFFF)[place >> 32 == mark]
            np.add.at(step, at, 1)
            np.add.at(step, at + WIDTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            n_words.append(len(starts))
            n_gone.append(int(gone.sum()))
            kept.append(kept_text(raw, starts, ends, gone).decode("utf-8", "replace"))
            spans.append([{"lo": int(a), "hi": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["id", "n_words", "n_removed", "kept", "spans"])


def repeats(docs: DataFrame, id_col="doc_id", text_col="text", stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """(unchanged, changed). unchanged: id, n_words, sha of its words joined by one space. changed: id, n_words, n_removed,
    kept (words that stay, joined by one space), spans (removed word ranges [lo, hi)).

    A word goes when a 50-word window over it also starts in a text with a smaller id. Null text counts as empty. Repeats inside one text stay,
    as do repeats between rows of one id. Different texts under one id are judged each by its own words: ranges are gathered by id, and a text takes
    those whose digest is that of its own words, and windows by the mark of its text (32 bits). Rows with a null id are neither changed nor a reason for
    change. An empty table gives no rows.
    """
    stage = stage or Stage(docs.sparkSession, "substring")
    texts = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    facts = texts.mapInArrow(_facts, "id bigint, n_words bigint, sha string, rows array<struct<key:bigint,whole:bigint,lo:int,hi:int>>")
    facts = stage.table(facts, "facts")
    rows = facts.filter("id is not null").select("id", F.inline("rows"))
    named = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = stage.table(named.filter("first < last").select("key"), "shared")
    # an inner join with distinct keys: a semi join would be pushed below the filter
    rows = stage.table(may_hold(rows, shared, "key").join(shared, "key"), "rows")
    # equal ranges behind one symbol: only the smallest id's needs a look at single windows
    firsts = stage.table(rows.groupBy("key", "whole").agg(F.min("id").alias("first")), "firsts")
    kinds = firsts.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    firsts = stage.table(firsts.join(kinds, "key"), "kinds")
    marked = rows.join(firsts, ["key", "whole"]).select("id", "lo", "hi", "whole", (F.col("id") > F.col("first")).alias("gone"), "mixed")
    marked = stage.table(marked.filter("gone or mixed"), "marked")
    span = F.struct("lo", "hi", "whole")
    per_text = marked.groupBy("id").agg(F.collect_list(F.when(F.col("gone"), span)).alias("gone"), F.collect_list(F.when(~F.col("gone"), span)).alias("checks"))
    some = stage.table(texts.join(per_text, "id").withColumn("mark", F.hash("text").bitwiseAND(0x7FFFFFFF)), "texts")
    stage.drop(rows, firsts)
    checks = some.filter(F.size("checks") > 0).select("id", "mark", "text", "checks").mapInArrow(_windows, "id bigint, window bigint, window2 bigint, place bigint")
    checks = stage.table(checks, "windows")
    least = checks.groupBy("window", "window2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("window", "window2", "first")
    least = stage.table(least, "least")
    late = checks.join(least, ["window", "window2"]).filter("id > first").select("id", "place")
    late = stage.table(late.groupBy("id").agg(F.collect_list("place").alias("more")), "late")
    changed = some.join(late, "id", "left").filter("size(gone) > 0 or more is not null").select("id", "text", "gone", "more", "mark")
    cut = "id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<lo:int,hi:int>>"
    changed = stage.table(changed.mapInArrow(_cut, cut), "changed")
    return facts.join(changed.select("id"), "id", "left_anti").select("id", "n_words", "sha"), changed


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    same, changed = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    same = same.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha")
    changed = changed.select("id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha"))
    return same.unionByName(changed).toDF("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 49 <= len(w) THEN sha256(array_to_string(w[i:i + 49], ' ')) END)) AS ahead FROM w),
f AS (SELECT ahead, min(doc_id) AS first FROM p WHERE ahead IS NOT NULL GROUP BY ahead),
m AS (SELECT doc_id, word, place, coalesce(bool_or(coalesce(first < doc_id, false)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN f USING (ahead)),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
