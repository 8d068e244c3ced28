"""MinHash near-dedup with sequential Bayesian verification (operator 1).

1. Each text becomes its set of 5-word shingles (64-bit hashes), a MinHash signature, and a digest of the set.
   Equal sets collapse to the smallest id at once.
2. Signatures are cut into bands; texts that share a band are candidates. So many bands are taken that a pair
   at the threshold is missed with at most the chosen probability.
3. Candidates compare signatures batch by batch. A pair is dropped once the posterior probability that its similarity
   reaches the threshold (uniform prior, binomial matches) falls below the miss probability.
4. Survivors are verified on their full shingle sets.

A bucket of m texts does not give m**2 pairs: first every member meets the bucket's smallest id. Then members that can link with
no other component are left out: a text whose shingles outside its own component are too few for the threshold. In buckets that still hold several
components, members of the largest go to one block each, the others to every block, and pairs between different
components are compared and verified inside tasks; only links that join components leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, blobs, lower, may_hold, mix, only, pack, shingle_set, texts_of, word_spans
from .components import components

SHINGLE = 5
#: Hashes of a band: so many that texts which share a passage seldom share a band, however large the corpus is.
BAND_ROWS = 6
#: Chosen probability of missing a pair at the threshold, for the bands and for each posterior bound.
MISS = 1e-6
#: Hashes compared between two looks at the posterior.
LOOK = 16
#: Members of a bucket that have their place in one task at most; larger buckets are cut into blocks.
BLOCK = 256


def bands_for(similarity: float, miss: float = MISS, rows: int = BAND_ROWS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def least_matches(similarity: float, hashes: int, miss: float = MISS, look: int = LOOK) -> list[tuple[int, int]]:
    """(hashes compared, matches needed): with fewer, P(similarity >= threshold | matches) < miss.

    With a uniform prior the posterior is Beta(m+1, n-m+1), whose tail is P(Binomial(n+1, threshold) <= m).
    """
    out = []
    for n in [*range(look, hashes, look), hashes]:
        tail, need = 0.0, 0
        for m in range(n + 2):
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= miss:
                need = m
                break
        out.append((n, need))
    return out


def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, hashes + 1, dtype=np.uint64)
    return mix(at) | np.uint64(1), mix(at + np.uint64(1 << 20))


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of each of ``hashes`` hash functions over a non-empty set."""
    a, b = _factors(hashes)
    out = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[lo : lo + 1024, None] * a + b).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sketches(hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for buf in texts_of(batch.column(1)):
                shingles = shingle_set(buf, SHINGLE)
                n.append(len(shingles))
                digest.append(hashlib.sha256(pack(shingles)).digest()[:16] if len(shingles) else None)
                sig.append(pack(signature(shingles, hashes)) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), blobs(digest), blobs(sig)], ["id", "mark", "n", "digest", "sig"])

    return run


def _bands(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()])
            keys = [band_keys(sigs, band) for band in range(bands)]
            ids = np.tile(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], ["key", "id"])

    return run


def _posterior(need: list[tuple[int, int]], share: tuple[int, int]):
    """Keep the pairs (a, b, n_a, sig_a, n_b, sig_b) that no look at the signatures rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()]) for c in ("sig_a", "sig_b"))
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = survivors(a, b, na, nb, need, share)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def survivors(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, need, share) -> np.ndarray:
    """Sequential looks over aligned signature rows; sizes too far apart rule a pair out exactly."""
    left = np.flatnonzero(np.minimum(na, nb) * share[1] >= np.maximum(na, nb) * share[0])
    matches, done = np.zeros(len(left), dtype=np.int64), 0
    for n, least in need:
        matches = matches + (a[left, done:n] == b[left, done:n]).sum(axis=1)
        stay = matches >= least
        left, matches, done = left[stay], matches[stay], n
    keep = np.zeros(len(a), dtype=bool)
    keep[left] = True
    return keep


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of 0/1 matrices over slices of their common members."""
    members, slot, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = np.flatnonzero(times > 1)
    column = np.full(len(members), -1)
    column[common] = np.arange(len(common))
    column = column[slot]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for lo in range(0, len(common), 4096):
        on = slice(*np.searchsorted(column, (lo, lo + 4096)))
        table = np.zeros((len(sets), 4096), dtype=np.float32)
        table[owner[on], column[on] - lo] = 1
        out += table @ table.T
    return out


def _find(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def shingle_words(buf: np.ndarray) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    raw, (starts, ends) = lower(buf).tobytes(), word_spans(buf)
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    width = min(SHINGLE, len(words))
    return set(zip(*(words[k : len(words) - width + 1 + k] for k in range(width)), strict=True))


def linked(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether the similarity of two texts' shingle sets, word by word, reaches the share."""
    a, b = shingle_words(x), shingle_words(y)
    both = len(a & b)
    return bool(a and b) and share[1] * both >= share[0] * (len(a) + len(b) - both)


def _block_links(need, share):
    """Rows (key, block, id, comp, hub, minor, home, n, sig, text), those of a (key, block) together -> links between different components.

    ``home`` rows belong to the block; ``minor`` ones, which are not in the bucket's largest component, are in every block. Each minor row meets
    the block's own rows, in the first band that the two share; survivors are verified on their full sets, and of the links that join the same
    two components one is confirmed word by word and returned.
    """

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = [r for r in rows if r[2] != r[4]]  # the star has met the hub
        if len({r[3] for r in rows}) < 2:
            return []
        ids, comp, minor, home, sizes = (np.array([r[k] for r in rows]) for k in (2, 3, 5, 6, 7))
        sigs = np.stack([np.frombuffer(r[8], np.uint32) for r in rows])
        grouped = sigs.reshape(len(rows), -1, BAND_ROWS)
        band = _band_of(grouped, rows[0][0])
        found: list[tuple[int, int]] = []
        for x in np.flatnonzero(minor):
            others = np.flatnonzero(home & (comp != comp[x]) & (~minor | (ids < ids[x])))
            others = others[np.minimum(sizes[others], sizes[x]) * share[1] >= np.maximum(sizes[others], sizes[x]) * share[0]]
            if band and len(others):
                others = others[~(grouped[others, :band] == grouped[x, :band]).all(axis=2).any(axis=1)]
            if len(others):
                mine = np.broadcast_to(sigs[x], (len(others), sigs.shape[1]))
                keep = others[survivors(mine, sigs[others], np.full(len(others), sizes[x]), sizes[others], need, share)]
                found += [(int(x), int(y)) for y in keep]
        if not found:
            return []
        used = sorted({x for pair in found for x in pair})
        place = {x: k for k, x in enumerate(used)}
        both = overlaps([shingle_set(np.frombuffer(rows[x][9], np.uint8), SHINGLE) for x in used])
        parent: dict[int, int] = {}
        out = []
        for x, y in found:
            n = both[place[x], place[y]]
            if share[1] * n >= share[0] * (sizes[x] + sizes[y] - n):
                a, b = _find(parent, int(comp[x])), _find(parent, int(comp[y]))
                if a != b and linked(np.frombuffer(rows[x][9], np.uint8), np.frombuffer(rows[y][9], np.uint8), share):
                    parent[a] = b
                    out.append((int(ids[x]), int(ids[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            links = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    links += compare(held)
                    held = []
                held.append(row)
            yield batch_of(links)
        if held:
            yield batch_of(compare(held))

    return run


def band_keys(sigs: np.ndarray, band: int) -> np.ndarray:
    h = np.full(len(sigs), band + 1, dtype=np.uint64)
    for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
        h = mix(h ^ (sigs[:, k].astype(np.uint64) + np.uint64(1 << 40)))
    return h.view(np.int64)


def _band_of(grouped: np.ndarray, key: int) -> int:
    """The band whose key this bucket has."""
    one = grouped[:1].reshape(1, -1)
    return next((b for b in range(grouped.shape[1]) if band_keys(one, b)[0] == key), 0)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, comp, text) -> a row for each shingle of the text: id is the shingle, of the text it is in."""
    for batch in batches:
        for own, comp, buf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
            found = shingle_set(buf, SHINGLE).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), own, np.int64)), pa.array(np.full(len(found), comp, np.int64))], ["id", "of", "comp"])


def able(members: DataFrame, texts: DataFrame, share: tuple[int, int], stage: Stage) -> DataFrame:
    """members(id, comp, n), one row an id -> ids of those that may link with another component: at least ``share`` of their shingles
    are in texts of other components too. Exact: no text left out has such a link. A shingle's row count never meets in one task."""
    rows = members.join(texts, "id").select("id", "comp", "text").mapInArrow(_shingle_rows, "id bigint, of bigint, comp bigint")
    rows = stage.table(rows, "shingles")
    common = rows.groupBy("id").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("id")
    shared = may_hold(rows, stage.table(common, "common")).groupBy("of").agg(F.count(F.lit(1)).alias("shared"))
    kept = members.join(shared.withColumnRenamed("of", "id"), "id").filter(F.col("shared") * share[1] >= F.col("n") * share[0])
    return stage.table(kept.select("id"), "able")


def _exact(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(x, y, share) for x, y in zip(texts_of(batch.column("text_a")), texts_of(batch.column("text_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _grouped(docs: DataFrame, id_col: str, text_col: str, share: tuple[int, int], miss: float, stage: Stage | None) -> DataFrame:
    """near_groups with ``mark``, a hash of the row's text."""
    stage = stage or Stage(docs.sparkSession, "near")
    similarity = share[0] / share[1]
    bands = bands_for(similarity, miss)
    hashes = bands * BAND_ROWS
    need = least_matches(similarity, hashes, miss)
    texts = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    marked = texts.withColumn("mark", F.xxhash64("text"))
    sketches = stage.table(marked.mapInArrow(_sketches(hashes), "id bigint, mark bigint, n bigint, digest binary, sig binary"), "sketches")
    rows = stage.table(sketches.select("id", "mark", "n", "digest"), "sizes")
    groups = rows.filter("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = stage.table(groups, "groups")
    reps = sketches.join(groups.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").select("id", "n", "sig")
    reps = stage.table(reps, "reps")
    stage.drop(sketches)
    keyed = reps.select("id", "sig").mapInArrow(_bands(bands), "key bigint, id bigint")
    keyed = stage.table(keyed, "bands")
    hubs = stage.table(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count(F.lit(1)).alias("m")).filter("hub < top").drop("top"), "hubs")
    members = stage.table(keyed.join(hubs, "key"), "members")
    stage.drop(keyed)
    star = stage.table(members.filter("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "star")
    wanted = stage.table(members.select("id").distinct(), "wanted")
    # inner joins with distinct ids: a semi join would be pushed below the filter
    some = stage.table(may_hold(texts, wanted).join(wanted, "id"), "texts")
    sigs = stage.table(may_hold(reps, wanted).join(wanted, "id"), "signatures")
    stage.drop(reps)

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_b = pairs.join(some.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_exact(share), "a bigint, b bigint")

    def side(x: str) -> DataFrame:
        return sigs.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    pairs = star.join(side("b"), "b").join(side("a"), "a").mapInArrow(_posterior(need, share), "a bigint, b bigint")
    pairs = stage.table(pairs, "survivors")
    links = stage.table(confirmed(pairs), "links")
    parts = components(links, stage)
    # what the stars leave open: buckets with members in different components
    inside = members.filter("m > 2").join(parts, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    inside = stage.table(inside, "inside")

    def open_rows(rows: DataFrame) -> DataFrame:
        open_keys = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).filter("low < high").select("key", "m")
        return rows.drop("m").join(stage.table(open_keys, "open"), "key")

    left = stage.table(open_rows(inside), "left")
    whole = left.select("id", "comp").distinct().join(sigs.select("id", "n"), "id")
    left = stage.table(open_rows(left.join(able(stage.table(whole, "whole"), some, share, stage), "id")), "left")
    largest = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"))
    left = left.join(stage.table(largest, "largest"), "key").withColumn("minor", F.col("comp") != F.col("largest"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int")
    visits = F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))
    left = left.select("key", "id", "comp", "hub", "minor", own.alias("own"), visits.alias("block"))
    left = left.join(sigs, "id").join(some.withColumn("text", F.col("text").cast("binary")), "id")
    left = left.select("key", "block", "id", "comp", "hub", "minor", (F.col("block") == F.col("own")).alias("home"), "n", "sig", "text")
    left = left.repartition("key", "block").sortWithinPartitions("key", "block")
    more = left.mapInArrow(_block_links(need, share), "a bigint, b bigint")
    links = links.unionByName(stage.table(more, "links"))
    parts = components(stage.table(links, "links"), stage)
    copies = groups.filter("copies > 1").select("digest", "rep")
    out = rows.join(copies, "digest", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = stage.table(out.select("id", "mark", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")), "reps_of")
    out = out.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "mark")


def near_groups(docs: DataFrame, id_col="doc_id", text_col="text", share: tuple[int, int] = (80, 100), miss: float = MISS, stage: Stage | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two texts are linked when share[1] * |A & B| >= share[0] * |A | B| over their shingle sets. component_id is the smallest id
    reachable over links; kept marks that row. Null and wordless texts have an empty set and are linked with nothing; a text of
    fewer than five words has one shingle. Rows with a null id are linked with nothing and kept. Different texts under one id are
    judged each by its own links, and join the components that they link with. Ids are integers. An empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col, share, miss, stage).drop("mark")


def drop_near_copies(docs: DataFrame, id_col="doc_id", text_col="text", share: tuple[int, int] = (80, 100), miss: float = MISS, stage: Stage | None = None) -> DataFrame:
    """``docs`` without the rows that another text of their component replaces; rows are told apart by id and text."""
    gone = _grouped(docs, id_col, text_col, share, miss, stage).filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__mark"]), "left_anti")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), share=(85, 100))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 0 THEN list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT id, b FROM reach JOIN edge ON a = other),
c AS (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
