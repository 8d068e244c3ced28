"""Exact top-k by inner product with dual cover trees (operator 4).

Vectors are dealt to cells around a bounded sample of pivots and cells are cut into blocks, so that a block holds near
vectors and a hot cell many blocks. A task gets one block of queries and one of candidates, builds a cover tree over each, and descends both
together: a pair of nodes is dropped when the bound from its covering radii,
``<cq, cp> + rq * |cp| + rp * |cq| + rq * rp``, is below the worst k-th score in the query node. Each task's best k are merged by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

#: Vectors that serve as pivots at most; candidates and queries of a block; points of a leaf.
PIVOTS, BLOCK, QUERY_BLOCK, LEAF = 64, 8192, 2048, 64


class Node:
    """A ball around ``center`` that holds ``points`` within ``radius``; children cover them at half the radius."""

    __slots__ = ("center", "radius", "norm", "points", "children")

    def __init__(self, data: np.ndarray, points: np.ndarray):
        self.points = points
        self.center = data[points[0]]
        gaps = data[points] - self.center
        far = np.sqrt((gaps * gaps).sum(axis=1))
        self.radius = float(far.max()) * (1 + 1e-9)
        self.norm = float(np.sqrt(self.center @ self.center))
        self.children: list[Node] = []
        if len(points) <= LEAF or self.radius == 0.0:
            return
        groups, left = [], points
        while len(left):
            if len(groups) > len(points) // 8:
                return  # half the radius does not gather these points: a leaf
            gaps = data[left] - data[left[0]]
            near = (gaps * gaps).sum(axis=1) <= (self.radius / 2) ** 2
            groups.append(left[near])
            left = left[~near]
        if len(groups) > 1:
            self.children = [Node(data, g) for g in groups]


def dual_search(queries: np.ndarray, q_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of shape (queries, k), best first, ties to smaller ids; -inf where there are fewer."""
    best = np.full((len(queries), k), -np.inf)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    q_root, p_root = Node(queries, np.arange(len(queries))), Node(data, np.arange(len(data)))

    def bound(q: Node, p: Node) -> float:
        return float(q.center @ p.center) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius

    queue, tick = [(-bound(q_root, p_root), 0, q_root, p_root)], 0
    while queue:
        upper, _, q, p = heapq.heappop(queue)
        if -upper + 1e-6 * abs(upper) + 1e-6 < best[q.points, k - 1].min():
            continue
        if q.children or p.children:
            wide = p.children if p.children and (p.radius >= q.radius or not q.children) else None
            for a, b in [(q, c) for c in wide] if wide else [(c, p) for c in q.children]:
                tick += 1
                heapq.heappush(queue, (-bound(a, b), tick, a, b))
            continue
        scores = queries[q.points] @ data[p.points].T
        scores[q_ids[q.points][:, None] == ids[p.points][None, :]] = -np.inf
        for row, point in enumerate(q.points):
            mine = scores[row]
            on = np.flatnonzero((mine >= best[point, k - 1]) & (mine > -np.inf))
            if len(on) > 4 * k:
                on = on[mine[on] >= np.partition(mine[on], -k)[-k]]
            if len(on):
                s, i = np.concatenate((best[point], mine[on])), np.concatenate((best_ids[point], ids[p.points[on]]))
                order = np.lexsort((i, -s))[:k]
                best[point], best_ids[point] = s[order], i[order]
    return best, best_ids


def _vectors(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(kept positions, matrix): vectors without null or non-finite components, shorter ones filled with zeros."""
    good = [i for i, v in enumerate(lists) if v is not None and all(x is not None for x in v) and np.isfinite(v).all()]
    wide = max((len(lists[i]) for i in good), default=0)
    out = np.zeros((len(good), wide))
    for row, i in enumerate(good):
        out[row, : len(lists[i])] = lists[i]
    return np.array(good, dtype=np.int64), out


def _cells(pivots: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _vectors(batch.column(1).to_pylist())
            x = np.floor(scale * x)
            wide = max(x.shape[1], pivots.shape[1])
            a, b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, pivots))
            cell = ((b * b).sum(axis=1)[None, :] - 2 * a @ b.T).argmin(axis=1) if len(b) else np.zeros(len(a))
            ids = batch.column(0).take(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cell.astype(np.int32)), pa.array([row.tobytes() for row in x], pa.binary())], ["id", "cell", "vector"])

    return run


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(v, np.float64) for v in table["vector"].to_pylist()]
        wide = max(map(len, raw))
        x = np.zeros((len(raw), wide))
        for row, v in enumerate(raw):
            x[row, : len(v)] = v
        ids, asks = table["id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        q, p = np.flatnonzero(asks), np.flatnonzero(~asks)
        q, p = q[np.unique(ids[q], return_index=True)[1]], p[np.unique(ids[p], return_index=True)[1]]
        empty = pa.Table.from_pydict({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not len(q) or not len(p):
            return empty
        best, found = dual_search(x[q], ids[q], x[p], ids[p], k)
        row, col = np.nonzero(best > -np.inf)
        return pa.Table.from_pydict({"query_id": ids[q][row], "vec_id": found[row, col], "score": best[row, col].astype(np.int64)})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col="vec_id", vector_col="embedding", stage: Stage | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products for each row whose id is divisible by ``every``, against all rows but
    its own id.

    Components become floor(scale * x). Null ids, null vectors and vectors with null or non-finite components take no part; vectors
    of unlike length meet on their common components. Of different vectors under one id the one whose scaled components are largest
    in byte order counts, whatever the layout; rows repeated whole count once. Fewer than k candidates give fewer rows.
    """
    stage = stage or Stage(vectors.sparkSession, "topk")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector")).filter("id is not null")
    sample = rows.filter("vector is not null").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("vector").collect()
    pivots = np.floor(scale * _vectors([r["vector"] for r in sample])[1])
    laid = stage.table(rows.mapInArrow(_cells(pivots, scale), "id bigint, cell int, vector binary"), "cells")
    twice = stage.table(laid.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "twice")
    if twice.head(1):
        one = laid.join(twice, "id").groupBy("id").agg(F.max(F.struct("vector", "cell")).alias("of")).select("id", "of.cell", "of.vector")
        laid = stage.table(laid.join(twice, "id", "left_anti").unionByName(one), "once")
    laid = laid.withColumn("asks", F.pmod("id", F.lit(every)) == 0)
    sizes = laid.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).orderBy("cell").collect()  # PIVOTS rows at most
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # candidate blocks: each cell's rows in equal hashed parts; query blocks: neighbouring cells together
    parts, first, at = [], [], 0
    for row in sizes:
        parts.append(max(1, -(-row["n"] // BLOCK)))
        first.append(at)
        at += parts[-1]
    query_blocks = max(1, -(-sum(r["q"] for r in sizes) // QUERY_BLOCK))
    place = {r["cell"]: i for i, r in enumerate(sizes)}
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for c, i in place.items() for x in (c, values[i])]), F.col("cell"))
    spread = F.pmod(F.xxhash64("id", F.lit(9)), pick(parts)).cast("int")
    group = max(1, at // max(1, -(-sum(r["n"] for r in sizes) // BLOCK)))  # small cells share a block
    block = F.floor((pick(first) + spread) / group).cast("int")
    total = (at - 1) // group + 1
    q_block = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(query_blocks)).cast("int")
    candidates = laid.withColumn("block", block).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("asks", F.lit(False))
    queries = laid.filter("asks").withColumn("q_block", q_block).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    both = candidates.unionByName(queries.select(candidates.columns)).select("block", "q_block", "id", "asks", "vector")
    found = both.groupBy("block", "q_block").applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.e, p.e)::BIGINT AS score FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
