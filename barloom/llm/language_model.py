"""Hierarchical Pitman-Yor language model (operator 3).

Restaurants: one for each previous word (and one for the start of a text), all sharing one unigram restaurant as parent, whose base is uniform over the vocabulary and one
unknown word. A word's customers in a context open tables; each table is a customer of the parent.

A text belongs to a block by a hash of its id and words, so that every pass over the texts deals them alike. A block's distinct (context, word) pairs and its
distinct words travel, once for each block, so neither a frequent word nor a frequent pair makes a large group. For scoring each block is stored once, as its
distinct words and its tokens' places among them, so that texts are shuffled and tokenised once and not for each question. Pairs are
dealt to buckets by a hash of both; what is summed for a word, or for a context, is dealt by its own hash (a *node*).
A pair met once has one customer at one table in every seating: such pairs are counted into their nodes once and then kept as bare keys.
A Gibbs sweep takes each other pair's customers and tables out and seats the customers again, given all other tables of the sweep before: pair buckets send their nodes the
tables, node buckets seat the unigram restaurant and answer with the totals. After the burn-in every sweep is kept, and scoring averages
their predictive probabilities: blocks ask for their pairs and nodes, and add up their own texts.

Data move as sorted number columns packed in binary rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, exp, inf, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, lower, mix, only, pack, span_hashes, texts_of, word_hashes, word_spans

#: Discount and strength of the contexts and of the unigram restaurant; sweeps thrown away and kept.
DISCOUNT, STRENGTH, DISCOUNT0, STRENGTH0 = 0.75, 5.0, 0.5, 100.0
BURN_IN, SAMPLES = 2, 3
#: Customers of a group that are seated one at a time before waits are drawn at once.
ONE_BY_ONE = 8
#: So few groups are seated with plain numbers: arrays cost more.
FEW = 24
#: Text bytes for each bucket of pairs; mean text bytes of a block; tokens counted together; passes in which pairs are asked for, to save disk.
BUCKET_BYTES, BLOCK_BYTES, GATHERED, PASSES = 16 << 20, 4 << 20, 1_000_000, 2
#: Bytes of text that are tokenised at once.
TOGETHER = 1 << 18
END, START = np.uint64(0x5EED0E4D5EED0E4D), np.uint64(0xA11CE5ED5EED57A7)
NO_ID = np.iinfo(np.int64).min


def tokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, context hash) of each token of one text, its end included."""
    words = np.append(word_hashes(lower(buf)), END)
    return words, np.concatenate(([START], words[:-1]))


def tokens_of(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, context hashes, numbers of tokens) of texts in turn, about ``TOGETHER`` bytes at once: ``tokens`` of each, end to end."""
    group, size = [], 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf = lower(np.frombuffer(b" ".join(group), np.uint8))  # a space parts the texts and belongs to no word
        starts, ends = word_spans(buf)
        at = np.cumsum([0, *[len(text) + 1 for text in group]])
        sizes = np.diff(np.searchsorted(starts, at)) + 1
        last = np.cumsum(sizes) - 1
        inner = np.ones(int(sizes.sum()), dtype=bool)
        inner[last] = False
        words = np.full(len(inner), END)
        words[inner] = span_hashes(buf, starts, ends)
        contexts = np.concatenate(([START], words[:-1]))
        contexts[last[:-1] + 1] = START
        return words, contexts, sizes

    for buf in texts:
        group.append(buf.tobytes())
        size += len(buf)
        if size >= TOGETHER:
            yield made()
            group, size = [], 0
    if group:
        yield made()


def _key(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(words ^ mix(contexts + np.uint64(0x9E3779B97F4A7C15)))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes are dealt to buckets by range: the bounds of all buckets, and the buckets that have any."""
    bucket = _bucket(sorted_hashes, buckets)
    bounds = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    return bounds, np.flatnonzero(np.diff(bounds))


def _schema(**columns) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(k, kinds[v]) for k, v in columns.items()])


def _ddl(schema: dict) -> str:
    return ", ".join(f"{k} {v}" for k, v in schema.items())


_B = "binary"
COUNTS = {"bucket": "int", "nodes": _B, "words": _B, "contexts": _B, "counts": _B}
#: Pairs with more customers than one.
SEATS = {"bucket": "int", "words": _B, "contexts": _B, "nodes": _B, "customers": _B, "tables": _B, "summed": _B}
#: kind 0: seats; 1: keys of pairs met once (nodes); 2: nodes of these pairs, times met as a word (customers) and as a context (tables).
FIRST = {"kind": "int", **SEATS}
SENT = {"node_bucket": "int", "bucket": "int", "nodes": _B, "sums": _B}
#: kind 0: the node bucket itself; 1: the answer to a pair bucket. base: what single pairs add; known: tokens, words, tables' sum, tops' sum.
NODES = {"kind": "int", "node_bucket": "int", "bucket": "int", "nodes": _B, "sums": _B, "tops": _B, "base": _B, "known": "array<bigint>"}
#: A block's texts: ids, numbers of tokens, distinct words with START (ascending), and each token's place among these.
STORED = {"block": "bigint", "ids": _B, "sizes": _B, "nodes": _B, "words": _B}
ASKED = {"bucket": "int", "block": "bigint", "hashes": _B}
#: kind 0: of pairs (float); 1: of nodes (whole numbers).
TOLD = {"block": "bigint", "kind": "int", "bucket": "int", "numbers": _B}
SCORES = "id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in table[name].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


# ---- blocks ------------------------------------------------------------------------


def blocked(rows: DataFrame, total: int) -> DataFrame:
    """(id, text) -> (block, id, text) for ``total`` bytes of text."""
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-total // BLOCK_BYTES)))).cast("long")
    return rows.select(block.alias("block"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "text")


class Pairs:
    """Distinct keys, ascending, of some tokens' pairs: where each is met first, and where each token's pair is among them."""

    def __init__(self, key: np.ndarray):
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        self.slots = np.empty(len(key), dtype=np.int64)
        self.slots[order] = np.cumsum(new) - 1
        self.keys, self.first = key[new], order[new]


def squeeze(values: np.ndarray) -> bytes:
    """``pack``, compressed byte by byte of the numbers: all first bytes, then all second ones. The size in front."""
    raw = np.ascontiguousarray(values).reshape(-1)
    planes = pack(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, kind) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def squeeze_hashes(ascending: np.ndarray) -> bytes:
    """Steps between hashes have leading zeros, which hashes have not."""
    return squeeze(np.diff(ascending, prepend=np.uint64(0)))


def unsqueeze_hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, np.uint64), dtype=np.uint64)


class Block:
    """The tokens of a block's texts, from a table of texts or from its stored row."""

    def __init__(self, table: pa.Table):
        self.number = table["block"][0].as_py()
        if "text" in table.column_names:
            words, _, self.sizes = (np.concatenate(side) for side in zip(*tokens_of(texts_of(table["text"])), strict=True))
            self.ids = table["id"].to_numpy()
            self.nodes, places = np.unique(np.append(words, START), return_inverse=True)
            self.words = places[:-1].astype(np.int32)
        else:
            row = table.to_pylist()[0]
            self.ids, self.sizes, self.words = (unsqueeze(row[name], kind) for name, kind in (("ids", np.int64), ("sizes", np.int64), ("words", np.int32)))
            self.nodes = unsqueeze_hashes(row["nodes"])
        self.at = np.cumsum(self.sizes) - self.sizes  # where texts begin
        self.contexts = np.concatenate((self.words[:1], self.words[:-1]))
        self.contexts[self.at] = np.searchsorted(self.nodes, START)

    def keys(self) -> np.ndarray:
        """The key of each token's pair."""
        return _key(self.nodes[self.words], self.nodes[self.contexts])


def _store(table: pa.Table) -> pa.Table:
    block = Block(table)
    row = {"block": block.number, "ids": squeeze(block.ids), "sizes": squeeze(block.sizes), "nodes": squeeze_hashes(block.nodes), "words": squeeze(block.words)}
    return pa.Table.from_pylist([row], schema=_schema(**STORED))


def _pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts and keys (ascending) of a row's pairs, and its nodes."""
    nodes = np.frombuffer(row["nodes"], np.uint64)
    words, contexts = nodes[np.frombuffer(row["words"], np.int32)], nodes[np.frombuffer(row["contexts"], np.int32)]
    return words, contexts, _key(words, contexts), nodes


def _trains(ids: np.ndarray, fold: int = 2, folds: int = 7) -> np.ndarray:
    import zlib

    distinct, slot = np.unique(ids, return_inverse=True)
    return np.array([i == NO_ID or zlib.crc32(str(i).encode()) % folds != fold for i in distinct.tolist()], dtype=bool)[slot]


def _each(make, schema: dict):
    """A mapInArrow function: ``make`` gives the rows that come of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(make(batch.slice(i, 1).to_pylist()[0]), schema=_schema(**schema))

    return run


# ---- training ------------------------------------------------------------------------


def _count(buckets: int):
    """(block, id, text) -> counts of the training texts' pairs, by bucket, for each GATHERED tokens."""

    def counted(gathered: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        words, contexts = (np.concatenate([t[k] for t in gathered]) for k in (0, 1))
        pairs = Pairs(_key(words, contexts))
        words, contexts, counts = words[pairs.first], contexts[pairs.first], np.bincount(pairs.slots).astype(np.int32)
        bounds, some = _cuts(pairs.keys, buckets)
        rows = []
        for b in some:
            s = slice(bounds[b], bounds[b + 1])
            nodes, where = np.unique(np.concatenate([words[s], contexts[s]]), return_inverse=True)
            word, context = np.split(where.astype(np.int32), 2)
            rows.append({"bucket": int(b), "nodes": squeeze_hashes(nodes), "words": squeeze(word), "contexts": squeeze(context), "counts": pack(counts[s])})
        return pa.RecordBatch.from_pylist(rows, schema=_schema(**COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in batches:
            training = (buf for on, buf in zip(_trains(batch.column(1).to_numpy()), texts_of(batch.column(2)), strict=True) if on)
            for some in tokens_of(training):
                gathered.append(some)
                n += len(some[0])
                if n >= GATHERED:
                    yield counted(gathered)
                    gathered, n = [], 0
        if gathered:
            yield counted(gathered)

    return run


def _seat_first(table: pa.Table) -> pa.Table:
    """Counts of one bucket -> its first seats: a table for each pair."""
    sent = [(unsqueeze_hashes(r["nodes"]), r) for r in table.to_pylist()]
    words, contexts = (np.concatenate([nodes[unsqueeze(r[side], np.int32)] for nodes, r in sent]) for side in ("words", "contexts"))
    pairs = Pairs(_key(words, contexts))
    keys, words, contexts = pairs.keys, words[pairs.first], contexts[pairs.first]
    customers = np.bincount(pairs.slots, weights=_joined(table, "counts", np.int32), minlength=len(keys)).astype(np.int32)
    once, more = np.flatnonzero(customers == 1), np.flatnonzero(customers > 1)
    nodes, where = np.unique(np.concatenate([words[more], contexts[more]]), return_inverse=True)
    where = where.astype(np.int32)
    empty = {"bucket": table["bucket"][0].as_py(), "words": b"", "contexts": b"", "customers": b"", "tables": b"", "summed": b""}
    seats = {"kind": 0, "words": pack(where[: len(more)]), "contexts": pack(where[len(more) :]), "nodes": pack(nodes), "customers": pack(customers[more]), "tables": pack(np.ones(len(more), np.int32)), "summed": pack(np.zeros(len(more), np.float32))}
    nodes, where = np.unique(np.concatenate([words[once], contexts[once]]), return_inverse=True)
    met = [np.bincount(side, minlength=len(nodes)).astype(np.int32) for side in (where[: len(once)], where[len(once) :])]
    rows = [empty | seats, empty | {"kind": 1, "nodes": pack(keys[once])}, empty | {"kind": 2, "nodes": pack(nodes), "customers": pack(met[0]), "tables": pack(met[1])}]
    return pa.Table.from_pylist(rows, schema=_schema(**FIRST))


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, rng, slope: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables after seating each group's customers one by one; the n-th opens a table with chance m / (n - discount * tables + m),
    where m = mass + slope * tables: what the group's own tables so far add to its mass.

    The first ``ONE_BY_ONE`` are drawn so. After them the wait for the next new table is drawn at once: an exponential draw is
    set against the integral of -log(1 - chance), which is solved by Newton's steps.
    """
    tables = np.ones(len(customers), dtype=np.int64)
    slope = np.broadcast_to(slope, mass.shape)
    live = np.flatnonzero(customers > 1)
    for n in range(1, ONE_BY_ONE):
        live = live[customers[live] > n]
        m = mass[live] + slope[live] * tables[live]
        tables[live] += rng.random(len(live)) * (n - discount * tables[live] + m) < m
    live = live[customers[live] > ONE_BY_ONE]
    made, seated, last = tables[live].astype(float), np.full(len(live), float(ONE_BY_ONE)), customers[live].astype(float)
    fixed, more = mass[live], slope[live]
    while len(live):
        m, draws = np.maximum(fixed + more * made, 1e-300), rng.exponential(size=len(live))
        if len(live) > FEW:
            seated = _next_tables(m, discount * made + 0.5, seated, last, draws)
        else:
            seated = np.array([_next_table(*x) for x in zip(m.tolist(), (discount * made + 0.5).tolist(), seated.tolist(), last.tolist(), draws.tolist(), strict=True)])
        made += seated <= last  # else everyone else finds a seat
        on = seated < last
        if not on.all():
            tables[live[~on]] = made[~on]
            live, made, seated, last, fixed, more = (x[on] for x in (live, made, seated, last, fixed, more))
    return tables


def _next_tables(m: np.ndarray, off: np.ndarray, seated: np.ndarray, last: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The customer of each group who opens its next table; infinite where none does."""
    area = lambda y, m: (y + m) * np.log(y + m) - y * np.log(y)
    low, end = seated - off, last - off
    start = area(low, m)
    goal = start + draws
    on = area(end, m) >= goal
    out = np.full(len(m), np.inf)
    m, off, seated, last, low, end, start, goal = (x[on] for x in (m, off, seated, last, low, end, start, goal))
    y = np.minimum(end, (low + m / 2) * np.exp(np.minimum((goal - start) / m, 600.0)) - m / 2)
    for _ in range(5):
        step = (area(y, m) - goal) / np.log1p(m / y)
        y = np.clip(y - step, low, end)
        if np.all(np.abs(step) < 1e-4):  # Newton's next step would be below 1e-9
            break
    out[on] = np.clip(np.ceil(y + off - 1e-9), seated + 1, last)
    return out


def _next_table(m: float, off: float, seated: float, last: float, draw: float) -> float:
    """``_next_tables`` of one group: a frequent pair opens thousands of tables after all others are done."""
    low, end = seated - off, last - off
    start = (low + m) * log(low + m) - low * log(low)
    goal = start + draw
    if (end + m) * log(end + m) - end * log(end) < goal:
        return inf
    y = min(end, (low + m / 2) * exp(min((goal - start) / m, 600.0)) - m / 2)
    for _ in range(5):
        step = ((y + m) * log(y + m) - y * log(y) - goal) / log1p(m / y)
        y = min(max(y - step, low), end)
        if abs(step) < 1e-4:
            break
    return min(max(ceil(y + off - 1e-9), seated + 1), last)


class Shared:
    """Totals of a sweep: training tokens, distinct words, the unigram restaurant's customers and tables."""

    def __init__(self, n: int, v: int, customers: int, tables: int):
        self.n, self.v, self.customers, self.tables = n, v, customers, tables

    def parent(self, customers: np.ndarray, tops: np.ndarray, out: np.ndarray | int = 0) -> np.ndarray:
        """The unigram restaurant's probability of words with these customers and tables, after ``out`` customers of the word left it."""
        new = (STRENGTH0 + DISCOUNT0 * self.tables) / (self.v + 1.0)
        left = customers - out
        return (left - DISCOUNT0 * np.minimum(tops, left) + new) / (STRENGTH0 + self.customers - out)


def _send(buckets: int):
    """What a pair bucket tells its nodes: customers and tables of each as a word, and as a context."""

    def make(row: dict) -> list[dict]:
        nodes = np.frombuffer(row["nodes"], np.uint64)
        customers, tables = np.frombuffer(row["customers"], np.int32), np.frombuffer(row["tables"], np.int32)
        sums = np.stack([np.bincount(np.frombuffer(row[side], np.int32), weights=x, minlength=len(nodes)) for side in ("words", "contexts") for x in (customers, tables)]).astype(np.int64)
        bounds, some = _cuts(nodes, buckets)
        return [{"node_bucket": int(b), "bucket": row["bucket"], "nodes": pack(nodes[s]), "sums": pack(sums[:, s])} for b in some for s in [slice(bounds[b], bounds[b + 1])]]

    return _each(make, SENT)


def _send_singles(buckets: int):
    def make(row: dict) -> list[dict]:
        nodes = np.frombuffer(row["nodes"], np.uint64)
        sums = np.stack([np.frombuffer(row[side], np.int32) for side in ("customers", "tables")])
        bounds, some = _cuts(nodes, buckets)
        return [{"node_bucket": int(b), "bucket": row["bucket"], "nodes": pack(nodes[s]), "sums": pack(sums[:, s])} for b in some for s in [slice(bounds[b], bounds[b + 1])]]

    return _each(make, SENT)


def _summed(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(where, weights=x, minlength=n) for x in values]).astype(np.int64)


def _node_base(table: pa.Table) -> pa.Table:
    """A node bucket with what the single pairs of all pair buckets add to it."""
    nodes, where = np.unique(_joined(table, "nodes", np.uint64), return_inverse=True)
    sent = np.concatenate([np.frombuffer(x, np.int32).reshape(2, -1) for x in table["sums"].to_pylist()], axis=1)
    base = _summed(where, sent, len(nodes))
    row = {"kind": 0, "node_bucket": table["node_bucket"][0].as_py(), "bucket": -1, "nodes": pack(nodes), "sums": b"", "tops": pack((base[0] > 0).astype(np.int32)), "base": pack(base), "known": None}
    return pa.Table.from_pylist([row], schema=_schema(**NODES))


def _node_turn(shared: Shared | None, seed: int):
    """Sum a node bucket, seat its words in the unigram restaurant, answer every pair bucket that sent. Left: what was sent; right: the node bucket."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, before = left.to_pylist(), right.to_pylist()
        number = (rows or before)[0]["node_bucket"]
        sizes = [len(r["nodes"]) // 8 for r in rows]
        old = np.frombuffer(before[0]["nodes"], np.uint64) if before else np.zeros(0, np.uint64)
        nodes, where = np.unique(np.concatenate([_joined(left, "nodes", np.uint64), old]), return_inverse=True)
        was, where = where[sum(sizes) :], where[: sum(sizes)]
        base, tops = np.zeros((2, len(nodes)), np.int64), np.zeros(len(nodes), np.int64)
        if before:
            base[:, was] = np.frombuffer(before[0]["base"], np.int64).reshape(2, -1)
            tops[was] = np.frombuffer(before[0]["tops"], np.int32)
        sums = base[[0, 0, 1, 1]]
        if rows:
            sums = sums + _summed(where, np.concatenate([np.frombuffer(r["sums"], np.int64).reshape(4, -1) for r in rows], axis=1), len(nodes))
        word = np.flatnonzero(sums[0])
        tops[word] = np.maximum(tops[word], 1)
        if shared is not None:
            rng = np.random.default_rng([seed, 1, number])
            others = shared.tables - tops[word]  # without the word's own tables
            tops = np.zeros(len(nodes), np.int64)
            tops[word] = seat(sums[1][word], (STRENGTH0 + DISCOUNT0 * others) / (shared.v + 1.0), DISCOUNT0, rng, DISCOUNT0 / (shared.v + 1.0))
        known = [int(sums[0].sum()), len(word), int(sums[1].sum()), int(tops.sum())]
        tops = tops.astype(np.int32)
        out = [{"kind": 0, "node_bucket": number, "bucket": -1, "nodes": pack(nodes), "sums": pack(sums), "tops": pack(tops), "base": pack(base), "known": known}]
        for r, lo, hi in zip(rows, np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes), strict=False):
            mine = where[lo:hi]
            out.append({"kind": 1, "node_bucket": number, "bucket": r["bucket"], "nodes": b"", "sums": pack(sums[1:4:2, mine]), "tops": pack(tops[mine]), "base": b"", "known": None})
        return pa.Table.from_pylist(out, schema=_schema(**NODES))

    return run


def _pair_turn(shared: Shared, seed: int, keep: bool):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        rng = np.random.default_rng([seed, 0, row["bucket"]])
        right = right.sort_by("node_bucket")
        totals = np.concatenate([np.zeros((2, 0), np.int64), *[np.frombuffer(x, np.int64).reshape(2, -1) for x in right["sums"].to_pylist()]], axis=1)
        tops = _joined(right, "tops", np.int32)
        word, context = np.frombuffer(row["words"], np.int32), np.frombuffer(row["contexts"], np.int32)
        customers, tables = np.frombuffer(row["customers"], np.int32).astype(np.int64), np.frombuffer(row["tables"], np.int32)
        p = shared.parent(totals[0][word], tops[word], tables)  # without the pair's own tables
        weight = STRENGTH + DISCOUNT * (totals[1][context] - tables)
        tables = seat(customers, weight * p, DISCOUNT, rng, DISCOUNT * p + weight / (STRENGTH0 + shared.customers))
        if keep:
            row["summed"] = pack(np.frombuffer(row["summed"], np.float32) + tables.astype(np.float32))
        row["tables"] = pack(tables.astype(np.int32))
        return pa.Table.from_pylist([row], schema=_schema(**SEATS))

    return run


def train(texts: DataFrame, buckets: int, stage: Stage) -> tuple[DataFrame, DataFrame, list[DataFrame], list[Shared]]:
    """Seats of all pairs of several customers after the last sweep, with sums over the kept sweeps; keys of single pairs; nodes (kind 0) and totals of each
    kept sweep. What no later step reads is deleted on the way."""

    def node_turn(seats: DataFrame, nodes: DataFrame, shared: Shared | None, sweep: int) -> tuple[DataFrame, Shared]:
        sent = seats.mapInArrow(_send(buckets), _ddl(SENT))
        turn = sent.groupBy("node_bucket").cogroup(nodes.filter("kind = 0").select(*NODES).groupBy("node_bucket"))
        out = stage.table(turn.applyInArrow(_node_turn(shared, sweep), _ddl(NODES)), "nodes", by="kind")
        known = out.filter("kind = 0").agg(*[F.coalesce(F.sum(F.col("known")[i]), F.lit(0)) for i in range(4)]).head()
        return out, Shared(*map(int, known))

    counted = texts.mapInArrow(_count(buckets), _ddl(COUNTS))
    first = stage.table(counted.groupBy("bucket").applyInArrow(_seat_first, _ddl(FIRST)), "first", by="kind")
    seats, singles = first.filter("kind = 0").select(*SEATS), first.filter("kind = 1").select("bucket", F.col("nodes").alias("singles"))
    told = first.filter("kind = 2").select("bucket", "nodes", "customers", "tables").mapInArrow(_send_singles(buckets), _ddl(SENT))
    base = stage.table(told.groupBy("node_bucket").applyInArrow(_node_base, _ddl(NODES)), "base")
    stage.drop_part(first, "kind=2")
    nodes, shared = node_turn(seats, base, None, 0)
    stage.drop(base)
    stage.paths[id(singles)] = stage.paths.pop(id(first))
    kept, kept_shared = [], []
    for sweep in range(BURN_IN + SAMPLES):
        answers = nodes.filter("kind = 1").select("node_bucket", "bucket", "sums", "tops")
        moved = seats.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_pair_turn(shared, sweep, sweep >= BURN_IN), _ddl(SEATS))
        moved = stage.table(moved, "seats")
        stage.drop_part(singles, "kind=0") if sweep == 0 else stage.drop(seats)
        seats = moved
        new, shared = node_turn(seats, nodes, shared, sweep + 1)
        if not any(nodes is k for k in kept):
            stage.drop(nodes)
        nodes = new
        if sweep >= BURN_IN:
            kept.append(nodes)
            kept_shared.append(shared)
    return seats, singles, kept, kept_shared


# ---- scoring ------------------------------------------------------------------------


def _ask(buckets: int, pairs: bool, part: int = 0, parts: int = 1):
    """A block's questions: its pairs' keys, or its nodes, by bucket; of each ``parts`` buckets one."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        hashes = block.keys() if pairs else block.nodes
        if parts > 1:
            hashes = hashes[_bucket(hashes, buckets) % np.uint64(parts) == part]
        if pairs:
            hashes = np.sort(hashes)
            hashes = hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]]
        bounds, some = _cuts(hashes, buckets)
        rows = [{"bucket": int(b), "block": block.number, "hashes": pack(hashes[bounds[b] : bounds[b + 1]])} for b in some]
        return pa.Table.from_pylist(rows, schema=_schema(**ASKED))

    return run


def _send_asked(ask):
    """What ``ask`` asks for stored blocks, hashes squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for asked in ask(pa.Table.from_batches([batch.slice(i, 1)])).to_batches():
                    hashes = [squeeze_hashes(np.frombuffer(x, np.uint64)) for x in asked["hashes"].to_pylist()]
                    yield asked.set_column(2, "hashes", pa.array(hashes, pa.binary()))

    return run


def _found(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked hash is among the known (ascending), and whether it is there."""
    at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
    return at, known[at] == asked if len(known) else np.zeros(len(asked), bool)


def _tell_pairs(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Each asked pair's customers less the discounts of its tables, averaged over the kept sweeps; 0 for pairs not met in training.
    Right: a row with the bucket's seats and one with the keys of its single pairs."""
    known, own, singles = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64)
    for row in right.to_pylist():
        if row["singles"] is not None:
            singles = np.frombuffer(row["singles"], np.uint64)
        else:
            known = _pairs_of(row)[2]
            own = np.maximum(np.frombuffer(row["customers"], np.int32) - DISCOUNT * np.frombuffer(row["summed"], np.float32) / SAMPLES, 0.0)
    out = []
    for r in left.to_pylist():
        asked = unsqueeze_hashes(r["hashes"])
        at, hit = _found(known, asked)
        numbers = np.where(_found(singles, asked)[1], np.float32(1.0 - DISCOUNT), np.float32(0.0))
        numbers[hit] = own[at[hit]]
        out.append({"block": r["block"], "kind": 0, "bucket": r["bucket"], "numbers": squeeze(numbers)})
    return pa.Table.from_pylist(out, schema=_schema(**TOLD))


def _steps(numbers: np.ndarray, samples: int, back: bool = False) -> np.ndarray:
    """Rows of nodes' numbers as what they differ by from an earlier row that is like them, and without signs, so that most bytes are 0; or ``back``."""
    like = [None, 0, *[0, *[2] * (samples - 1)], *[None, *[2 + samples] * (samples - 1)], *[1, *[2 + 2 * samples] * (samples - 1)]]
    out = (numbers >> 1) ^ -(numbers & 1) if back else numbers.copy()
    for k, earlier in enumerate(like):
        if earlier is not None:
            out[k] += out[earlier] if back else -numbers[earlier]
    return out if back else (out << 1) ^ (out >> 63)


def _tell_nodes(samples: int):
    """Whole numbers of each asked node (0 for one not met in training): its training count, its customers as a context, and of each kept sweep its tables as a
    word, these tables' tables in the unigram restaurant, and its tables as a context; as ``_steps``."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(right.to_pylist(), key=lambda r: r["sample"])
        known, numbers = np.zeros(0, np.uint64), np.zeros((2 + 3 * samples, 0), np.int64)
        if rows:
            known = np.frombuffer(rows[0]["nodes"], np.uint64)
            sums = np.stack([np.frombuffer(r["sums"], np.int64).reshape(4, -1) for r in rows])
            tops = np.stack([np.frombuffer(r["tops"], np.int32) for r in rows])
            numbers = _steps(np.concatenate([sums[0, [0, 2]], sums[:, 1], tops, sums[:, 3]]), samples)
        out = []
        for r in left.to_pylist():
            at, hit = _found(known, unsqueeze_hashes(r["hashes"]))
            told = np.zeros((len(numbers), len(hit)), np.int64)
            told[:, hit] = numbers[:, at[hit]]
            out.append({"block": r["block"], "kind": 1, "bucket": r["bucket"], "numbers": squeeze(told)})
        return pa.Table.from_pylist(out, schema=_schema(**TOLD))

    return run


def _score(shared: list[Shared]):
    """Sums of one block's texts."""
    n, v, samples = shared[-1].n, shared[-1].v, len(shared)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        mine = Pairs(block.keys())
        word, context = block.words[mine.first], block.contexts[mine.first]
        right = right.sort_by("bucket")
        of_pairs, of_nodes = (right.filter(pc.equal(right["kind"], k))["numbers"].to_pylist() for k in (0, 1))
        own = np.concatenate([unsqueeze(x, np.float32) for x in of_pairs]).astype(np.float64)
        numbers = _steps(np.concatenate([unsqueeze(x, np.int64).reshape(2 + 3 * samples, -1) for x in of_nodes], axis=1), samples, back=True)
        counts, customers, words, tops, contexts = numbers[0], numbers[1], *np.split(numbers[2:], 3)
        fine = lambda x: x.astype(np.float32).astype(np.float64)
        back = np.zeros(len(word))
        for s, sample in enumerate(shared):
            back += fine((STRENGTH + DISCOUNT * contexts[s]) / (STRENGTH + customers))[context] * fine(sample.parent(words[s], tops[s]))[word]
        p = own * fine(1.0 / (STRENGTH + customers))[context] + back / samples
        add = lambda x: np.add.reduceat(x[mine.slots], block.at)  # noqa: E731  every text has its end token
        cols = [block.ids, block.sizes, add((counts > 0).astype(np.int64)[word]), add(np.log10((counts + 1.0) / (n + v + 1.0))[word]), add(np.log10(p))]
        return pa.Table.from_arrays([pa.array(c) for c in cols], ["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, id_col="doc_id", text_col="text", stage: Stage | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Trained on the texts whose crc32(id) mod 7 is not 2 (a null id trains); scores are log10 probabilities of whole texts, averaged
    predictive probabilities of the kept sweeps. Null text is empty and has one token, its end. Ids are integers; rows
    with one id, or with none, are scored each on its own, and each counts in training. An empty table gives no rows. Draws are seeded by bucket and sweep.
    """
    stage = stage or Stage(docs.sparkSession, "lm")
    rows = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    texts = blocked(rows, total)
    seats, singles, nodes, shared = train(texts, buckets, stage)
    for one in nodes:
        stage.drop_part(one, "kind=1")
    stored = stage.table(texts.groupBy("block").applyInArrow(_store, _ddl(STORED)), "blocks")
    none = F.lit(None).cast("binary")
    pair_rows = seats.select("bucket", "words", "contexts", "nodes", "customers", "summed", none.alias("singles"))
    pair_rows = pair_rows.unionByName(singles.select("bucket", *[none.alias(c) for c in ("words", "contexts", "nodes", "customers", "summed")], "singles"))
    told = []
    for part in range(PASSES):
        asked = stored.mapInArrow(_send_asked(_ask(buckets, True, part, PASSES)), _ddl(ASKED)).groupBy("bucket")
        told.append(stage.table(asked.cogroup(pair_rows.filter(F.col("bucket") % PASSES == part).groupBy("bucket")).applyInArrow(_tell_pairs, _ddl(TOLD)), "told"))
    stage.drop(seats, singles)
    kept = None
    for s, one in enumerate(nodes):
        one = one.filter("kind = 0").select(F.col("node_bucket").alias("bucket"), F.lit(s).alias("sample"), "nodes", "sums", "tops")
        kept = one if kept is None else kept.unionByName(one)
    asked = stored.mapInArrow(_send_asked(_ask(buckets, False)), _ddl(ASKED)).groupBy("bucket")
    told.append(stage.table(asked.cogroup(kept.groupBy("bucket")).applyInArrow(_tell_nodes(len(shared)), _ddl(TOLD)), "told"))
    stage.drop(*nodes)
    answers = reduce(DataFrame.unionByName, told)
    sums = stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shared), SCORES)
    out = sums.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return out.select(
        F.col("id").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", F.lit(shared[-1].n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )


def op3_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
