"""Byte-level BPE encoding and decoding (operator 6).

Each pre-token is merged with a priority queue of (rank, position) over a doubly linked list of symbols; entries
whose symbols have changed since are stale and skipped. Decoding concatenates vocabulary strings.
The vocabulary file is a parameter; tasks load it once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import only, texts_of

#: Fixed pattern of the byte-level pre-tokenizer of the vocabulary's format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a task keeps at hand; the table is emptied when it is full.
KEPT = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself if printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe(dict):
    """Encoder and decoder; as a dict, pre-token -> its ids as little-endian bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first = [vocab[s] for s in symbols]
        back = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, data: bytes) -> list[int]:
        ids = [self.first[b] for b in data]
        n, merges = len(ids), self.merges
        after, prior = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(*merges[pair], i, pair) for i in range(n - 1) if (pair := (ids[i], ids[i + 1])) in merges]
        queue = [(rank, i, new, pair) for rank, new, i, pair in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, (left, right) = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                prior[k] = i
                if (found := merges.get(pair := (new, ids[k]))) is not None:
                    heapq.heappush(queue, (found[0], i, found[1], pair))
            if (h := prior[i]) >= 0 and (found := merges.get(pair := (ids[h], new))) is not None:
                heapq.heappush(queue, (found[0], h, found[1], pair))
        return [x for x in ids if x >= 0]

    def __missing__(self, token: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        out = np.array(self.merged(token.encode()), dtype="<u4").tobytes()
        if len(token) <= 64:
            self[token] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return b"".join([self[t] for t in self.split.findall(text)])
        parts = self.cut.split(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else b"".join([self[t] for t in self.split.findall(p)]) for p in parts if p)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def _loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for buf in texts_of(batch.column(1)):
                coded = bpe.encode(buf.tobytes().decode("utf-8", "replace"))
                n.append(len(coded) // 4)
                text = bpe.decode(coded)
                ids.append(hashlib.sha256(coded).hexdigest() if digests else np.frombuffer(coded, dtype="<u4").astype(np.int32))
                decoded.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, pa.string())], ["id", "n", "ids", "decoded"])
        bpe.clear()  # a worker goes on to other tasks

    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string) for each row; null text is empty and has no ids."""
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_encoder(path or vocabulary_path(), False), f"id {kind}, n bigint, ids array<int>, decoded string")
    return out.toDF("doc_id", "n_tokens", "ids", "decoded")


def encode_digests(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode_documents finds, hashed inside the task."""
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_encoder(path or vocabulary_path(), True), f"id {kind}, n bigint, ids string, decoded string")
    return out.toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _rows_encoder(path: str, text_col: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            ids, same = [], []
            for buf in texts_of(batch.column(text_col)):
                text = buf.tobytes().decode("utf-8", "replace")
                coded = bpe.encode(text)
                ids.append(np.frombuffer(coded, dtype="<u4").astype(np.int32))
                same.append(bpe.decode(coded) == text)
            rest = [batch.column(n) for n in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=schema.names)
        bpe.clear()

    return run


def encode_rows(docs: DataFrame, path: str | None = None, text_col="text") -> DataFrame:
    """``docs`` with n_tokens, ids and round_trip (decoding gives the text again) in place of the text. Columns that have these names already are replaced;
    null text is empty and has no ids; every other column is passed through."""
    rest = docs.drop(text_col, "n_tokens", "ids", "round_trip")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    names = pa.schema([(n, pa.null()) for n in [*rest.columns, "n_tokens", "ids", "round_trip"]])
    return docs.mapInArrow(_rows_encoder(path or vocabulary_path(), text_col, names), f"{kinds}, n_tokens bigint, ids array<int>, round_trip boolean")
