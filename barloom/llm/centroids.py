"""Centroid clustering by dual-tree Lloyd rounds (operator 13).

Vectors are packed once into blocks of distinct vectors. A round builds a cover tree over each block and a tree over the centroids and
descends both: for a node of vectors, a centroid node is dropped when its nearest possible centroid is farther than the farthest possible one of another. What
one centroid is left for goes to it whole; leaves are compared exactly. Tasks add up their vectors by centroid, so a round
shuffles at most one number for each task, centroid and component. All arithmetic that decides is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, only

#: Vectors of a block and points of a leaf; centroids of a leaf; children tried before a node is a leaf; most centroids, which the driver keeps.
BLOCK, LEAF, CENTROID_LEAF, TRIES, MOST_CENTROIDS = 8192, 32, 4, 64, 4096
#: Components up to this size are compared in doubles, which then are exact; above in 64-bit integers, up to the size at which a distance still fits.
EXACT, LARGEST = 1 << 21, 1 << 27


class Tree:
    """Cover tree over the rows of ``points``, as arrays: ``order`` lists rows so that node i holds order[lo[i]:hi[i]]; its ball is around row center[i]
    with radius[i]; its children are the nodes first[i] to last[i] - 1, around points more than half its radius apart; a leaf has none."""

    __slots__ = ("order", "lo", "hi", "center", "radius", "first", "last")

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        lo, hi, center, radius, first, last = [0], [len(points)], [0], [0.0], [0], [0]
        i = 0
        while i < len(lo):
            rows = self.order[lo[i] : hi[i]]
            gaps = points[rows] - points[center[i]]
            far = np.sqrt((gaps * gaps).sum(axis=1))
            radius[i] = float(far.max()) * (1 + 1e-12)
            groups = self._net(points, rows, radius[i] / 2) if len(rows) > leaf and radius[i] > 0 else []
            if len(groups) > 1:
                first[i] = len(lo)
                at = lo[i]
                for group in groups:
                    self.order[at : at + len(group)] = group
                    for values, value in ((lo, at), (hi, at + len(group)), (center, int(group[0])), (radius, 0.0), (first, 0), (last, 0)):
                        values.append(value)
                    at += len(group)
                last[i] = len(lo)
            i += 1
        self.lo, self.hi, self.center, self.first, self.last = (np.array(x, dtype=np.int64) for x in (lo, hi, center, first, last))
        self.radius = np.array(radius)

    @staticmethod
    def _net(points: np.ndarray, rows: np.ndarray, within: float) -> list[np.ndarray]:
        """Groups around points more than ``within`` apart. After ``TRIES`` groups those with one point, and what is left, are one group;
        none at all if the others gather less than an eighth of the rows."""
        groups, left = [], rows
        while len(left) and len(groups) < TRIES:
            gaps = points[left] - points[left[0]]
            near = (gaps * gaps).sum(axis=1) <= within * within
            groups.append(left[near])
            left = left[~near]
        if not len(left):
            return groups
        gathered = [g for g in groups if len(g) > 1]
        if 8 * sum(map(len, gathered)) < len(rows):
            return []
        return [*gathered, np.concatenate([*[g for g in groups if len(g) == 1], left])]


def _exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exact."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def nearest(tree: Tree, points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each point, of equally near ones the smallest number; and how many exact distances that took."""
    near = np.zeros(len(points), dtype=np.int64)
    over = Tree(centers.astype(float), CENTROID_LEAF)
    places = points.astype(float)
    hubs = centers.astype(float)[over.center]
    stack, compared = [(0, np.zeros(1, dtype=np.int64))], 0
    while stack:
        node, at = stack.pop()
        gaps = hubs[at] - places[tree.center[node]]
        apart, reach = np.sqrt((gaps * gaps).sum(axis=1)), tree.radius[node] + over.radius[at]
        least, most = apart - reach, (apart + reach).min()
        at = at[least <= most + 1e-9 * (1 + most)]
        wide = over.last[at] > over.first[at]
        leaf = tree.last[node] == tree.first[node]
        rows = tree.order[tree.lo[node] : tree.hi[node]]
        if len(at) == 1 and over.hi[at[0]] - over.lo[at[0]] == 1:
            near[rows] = over.order[over.lo[at[0]]]
        elif wide.any() and (leaf or over.radius[at].max() >= tree.radius[node]):
            inner = [np.arange(over.first[i], over.last[i]) for i in at[wide]]
            stack.append((node, np.concatenate([at[~wide], *inner])))
        elif not leaf:
            stack += [(child, at) for child in range(tree.first[node], tree.last[node])]
        else:
            numbers = np.sort(np.concatenate([over.order[over.lo[i] : over.hi[i]] for i in at]))
            near[rows] = numbers[_exact_distances(points[rows], centers[numbers]).argmin(axis=1)]
            compared += len(rows) * len(numbers)
    return near, compared


def whole_numbers(lists: pa.Array, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions kept, floor(scale * x)): vectors of ``width`` finite components whose distances fit a long."""
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    flat = lists.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * flat)
        good = (np.abs(flat) <= LARGEST).all(axis=1)  # false for NaN and infinity
    return at[good], flat[good].astype(np.int64)


_BLOCK = "ids array<bigint>, which binary, points binary, n int"


def _blocks(width: int, scale: float):
    """(id, vector) -> blocks: the ids, for each the number of its distinct vector, and the distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, size = [], [], 0
        for batch in batches:
            at, x = whole_numbers(batch.column(1), width, scale)
            ids.append(batch.column(0).take(pa.array(at)))
            rows.append(x)
            size += len(at)
            while size >= BLOCK:
                all_ids, all_rows = pa.concat_arrays(ids), np.concatenate(rows)
                yield packed(all_ids.slice(0, BLOCK), all_rows[:BLOCK])
                ids, rows, size = [all_ids.slice(BLOCK)], [all_rows[BLOCK:]], size - BLOCK
        if size:
            yield packed(pa.concat_arrays(ids), np.concatenate(rows))

    def packed(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        points, which = np.unique(x, axis=0, return_inverse=True)
        offsets = pa.array([0, len(ids)], pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, ids), pa.array([which.astype("<i4").tobytes()], pa.binary()), pa.array([points.astype("<i4").tobytes()], pa.binary()), pa.array([len(points)], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["ids", "which", "points", "n"])

    return run


def _assigned(batch: pa.RecordBatch, centers: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, number of each row's distinct vector, distinct vectors, their nearest centroids) of each block."""
    for i in range(batch.num_rows):
        which = np.frombuffer(batch.column(1)[i].as_py(), "<i4")
        points = np.frombuffer(batch.column(2)[i].as_py(), "<i4").reshape(batch.column(3)[i].as_py(), -1)
        large = max(np.abs(points).max(initial=0), np.abs(centers).max(initial=0)) > EXACT
        points = points.astype(np.int64 if large else np.float64)
        near, _ = nearest(Tree(points.astype(float), LEAF), points, centers.astype(points.dtype))
        yield batch.column(0)[i].values, which, points, near


def _sums(centers: np.ndarray):
    """Blocks -> (cluster, at, total): sums of this task's vectors by centroid; at -1 counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centers.shape, np.int64), np.zeros(len(centers), np.int64)
        for batch in batches:
            for _, which, points, near in _assigned(batch, centers):
                copies = np.bincount(which, minlength=len(points))
                np.add.at(total, near, points.astype(np.int64) * copies[:, None])
                count += np.bincount(near, copies, minlength=len(centers)).astype(np.int64)
        some = np.flatnonzero(count)
        width = centers.shape[1]
        cluster, at = np.repeat(some, width + 1), np.tile(np.arange(-1, width), len(some))
        values = np.concatenate((count[some, None], total[some]), axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(values)], ["cluster", "at", "total"])

    return run


def _labels(centers: np.ndarray):
    """Blocks -> (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, which, points, near in _assigned(batch, centers):
                gaps = points.astype(np.int64) - centers[near]
                yield pa.RecordBatch.from_arrays([ids, pa.array(near[which].astype(np.int32)), pa.array((gaps * gaps).sum(axis=1)[which])], ["id", "cluster", "distance"])

    return run


def seeds(rows: DataFrame, k: int, width: int, scale: float, key: Column) -> np.ndarray:
    """The k rows of smallest key; of equal keys, the smaller vector. Null keys come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_numbers(batch.column(1), width, scale)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), vectors], ["key", "vector"])

    found = rows.select(key.alias("key"), "vector").mapInArrow(run, "key string, vector array<bigint>")
    return np.array([r["vector"] for r in found.orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()], dtype=np.int64).reshape(-1, width)


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: float = 256.0, seed: int = 2, id_col="vec_id", vector_col="embedding", stage: Stage | None = None) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids): whole-number Lloyd rounds from the k vectors with the smallest SHA-256 of ``seed:id``, and a last assignment.

    Kept are vectors of exactly ``width`` components, none null, non-finite or beyond ``LARGEST`` after scaling (their distances would not fit a long); components
    become floor(scale * x). A centroid becomes the floored mean of its vectors, an empty one stays. Fewer than k vectors give fewer
    centroids, no vectors no rows. Rows with repeated or null ids are vectors like others; null ids become starting centroids last. The driver keeps
    the centroids (``MOST_CENTROIDS`` at most), no vectors besides.
    """
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"k is 1 to {MOST_CENTROIDS}")
    stage = stage or Stage(vectors.sparkSession, "centroids")
    rows = only(vectors, id=id_col, vector=vector_col).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    centers = seeds(rows, k, width, scale, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    if not len(centers):
        return vectors.sparkSession.createDataFrame([], "id bigint, cluster int, distance bigint"), centers
    blocks = stage.table(rows.mapInArrow(_blocks(width, scale), _BLOCK), "blocks")
    for _ in range(rounds):
        sums = np.zeros((len(centers), width + 1), dtype=object)
        for r in blocks.mapInArrow(_sums(centers), "cluster int, at int, total bigint").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect():  # centroids times components
            sums[r["cluster"], r["at"] + 1] = r["total"]
        centers = np.array([[int(total) // int(n) for total in row] if n else old.tolist() for old, (n, *row) in zip(centers, sums, strict=True)], dtype=np.int64)
    return blocks.mapInArrow(_labels(centers), "id bigint, cluster int, distance bigint"), centers


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "centroids")
    labels, centers = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), stage=stage)
    labels = stage.table(labels.withColumnRenamed("id", "vec_id"), "labels")
    by_cluster = {r["cluster"]: r["n"] for r in labels.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row for each centroid
    total = sum(by_cluster.values())
    rows = [(i, by_cluster.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centers.tolist())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return labels.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_NEAREST = """a{i} AS MATERIALIZED (SELECT v.vec_id, v.row, any_value(v.e) AS e, arg_min(c.n, struct_pack(d := CAST(list_sum(list_transform(list_zip(v.e, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), n := c.n)) AS cluster,
  min(CAST(list_sum(list_transform(list_zip(v.e, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)) AS distance FROM v, c{i} AS c GROUP BY v.vec_id, v.row)"""
_MOVED = """s{i} AS (SELECT cluster, pos, sum(x) AS total, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(1, 65)) AS pos FROM a{i}) AS q GROUP BY cluster, pos),
m{i} AS (SELECT cluster, list(CAST(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY pos) AS c FROM s{i} GROUP BY cluster), c{j} AS MATERIALIZED (SELECT c{i}.n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.cluster = c{i}.n)"""
SQL = (
    """WITH k AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM k),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS n, e AS c FROM (SELECT e, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h NULLS LAST, e LIMIT 40) AS q),
"""
    + ",\n".join(_NEAREST.format(i=i) + ",\n" + _MOVED.format(i=i, j=i + 1) for i in range(5))
    + ",\n"
    + _NEAREST.format(i=5)
    + """
SELECT a.vec_id, CAST(a.cluster AS INT) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a5 AS a JOIN c5 AS c ON c.n = a.cluster"""
)
