"""Exact dedup with a heavy-hitter split (operator 9).

Digests that hold a large share of the rows are found by Misra-Gries summaries,
counted exactly, and broadcast, so that their rows are settled on the map side and
never shuffled. Every other digest is settled by an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, only

#: Counters of a Misra-Gries summary: a digest with over 1/COUNTERS of all rows cannot be missed.
COUNTERS = 256


def misra_gries(counts: Counter, k: int) -> Counter:
    """Shrink a counter to at most k entries by taking the (k+1)th largest count from all."""
    if len(counts) <= k:
        return counts
    least = sorted(counts.values(), reverse=True)[k]
    return Counter({key: n - least for key, n in counts.items() if n > least})


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            counted = batch.column(0).value_counts()
            for key, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist(), strict=True):
                held[key] += n
            held = misra_gries(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return run


def heavy_digests(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most k candidate digests (column ``digest``), among them all with over 1/(k+1) of the rows.

    Each task sends at most k counters; they are summed, and the k largest sums are the candidates.
    A digest with share f keeps at least (f - 1/(k+1)) of the rows in these sums.
    """
    local = digests.select("digest").mapInArrow(_summaries(k), "digest binary, n bigint")
    return local.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).filter("n > 1").select("digest")


def settle(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """rows(id, digest, ...) with keep_id (largest id of the digest) and group_size added.

    ``rows`` is read three times, so it should be a stored table. A null id never wins over another.
    """
    tally = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    heavy = heavy_digests(rows, k)
    winners = rows.join(F.broadcast(heavy), "digest").groupBy("digest").agg(*tally)
    marked = rows.join(F.broadcast(winners), "digest", "left")
    own = Window.partitionBy("digest")
    rest = marked.filter("group_size is null").drop("keep_id", "group_size")
    rest = rest.withColumn("keep_id", F.max("id").over(own)).withColumn("group_size", F.count(F.lit(1)).over(own))
    return marked.filter("group_size is not null").unionByName(rest)


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the UTF-8 text, null counting as empty."""
    return only(docs, id=id_col, text=text_col).select("id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are (SHA-256); null counts as empty. The row with the
    largest id stays; a null id stays only in a group without any other (keep_id is then null).
    Rows repeated with one id and one text all count in group_size and are marked alike.
    An empty table gives no rows; other columns are not read.
    """
    stage = Stage(docs.sparkSession, "exact")
    rows = stage.table(digests_of(docs, id_col, text_col), "digests")
    return settle(rows, k).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text with a larger id replaces."""
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]) & (sha == gone["__sha"]), "left_anti")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
"""
