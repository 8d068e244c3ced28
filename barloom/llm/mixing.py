"""Mixing sources to target weights by a time-varying curriculum (operator 8).

Training runs over positions 0..T, T being the words of all documents. A source's share of
the running stream changes linearly over training; its integral is the cumulative demand
D(t) = target * (t + a * (t**2 - t)), which reaches the source's target at t = 1. The documents of a source lie
end to end in a fixed pseudo-random order, repeated up to ``max_repeats`` times; each occurrence starts
where D reaches the words before it, so inverting D gives its training position. Sorting by
position then gives the curriculum. Everything is DataFrame work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the contract: weights of the sources in order, and the most times a source is taken.
WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
#: Slope of each weight's schedule: shares go from (1-a) to (1+a) times the target's pace.
RAMPS = (0.5, 0.0, -0.5)
#: Documents of a leaf and leaves of a branch, of the tree in which running totals are taken.
LEAF, BRANCH = 64, 1024


def _cycled(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(source, size) -> one row a source: source, source_size, weight, ramp, target, total.

    Water-filling in closed form: sources sorted by cap/weight stop at their cap while that ratio is no
    larger than what is left for each unit of weight; the others share what is left. The table has a row a source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    out = each.withColumn("rank", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", _cycled(weights, F.col("rank"))).withColumn("ramp", _cycled(ramps, F.col("rank")))
    out = out.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("total", F.sum("source_size").over(whole))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = out.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    open_level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(whole)["level"]
    out = out.withColumn("water", open_level)
    return out.select("source", "source_size", "weight", "ramp", "total", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def running_offsets(rows: DataFrame, keys: list[str], leaves: int) -> DataFrame:
    """rows(*keys, order, size) with ``before``: the words before each row in its source.

    A running total in three levels (row, leaf, branch), so that no task needs all rows of a source.
    ``order`` is a pseudo-random non-negative long; a leaf is a range of it.
    """
    rows = rows.withColumn("leaf", F.shiftright("order", 63 - int(math.log2(leaves))).cast("int"))
    rows = rows.withColumn("branch", F.floor(F.col("leaf") / BRANCH).cast("int"))
    leaf = rows.groupBy(*keys, "branch", "leaf").agg(F.sum("size").alias("leaf_size"))
    branch = leaf.groupBy(*keys, "branch").agg(F.sum("leaf_size").alias("branch_size"))
    up_to = (Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    over = F.sum("branch_size").over(Window.partitionBy(*keys).orderBy("branch").rowsBetween(*up_to))
    branch = branch.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("branch").alias("b_branch"), F.coalesce(over, none).alias("branch_before"))
    over = F.sum("leaf_size").over(Window.partitionBy(*keys, "branch").orderBy("leaf").rowsBetween(*up_to))
    leaf = leaf.withColumn("in_branch", F.coalesce(over, none))
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    leaf = leaf.join(branch, [*same, F.col("branch") == F.col("b_branch")]).select(
        *[F.col(k).alias(f"l_{k}") for k in keys], F.col("leaf").alias("l_leaf"), (F.col("branch_before") + F.col("in_branch")).alias("leaf_before")
    )
    own = Window.partitionBy(*keys, "leaf").orderBy("order", "id", "size").rowsBetween(*up_to)
    rows = rows.withColumn("in_leaf", F.coalesce(F.sum("size").over(own), none))
    same = [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys]
    return rows.join(leaf, [*same, F.col("leaf") == F.col("l_leaf")]).withColumn("before", F.col("leaf_before") + F.col("in_leaf"))


def _position(words_before: Column) -> Column:
    """Inverse of the cumulative demand, as a share of training; beyond the target it goes on in a line."""
    u, a = words_before / F.greatest(F.col("target"), F.lit(1e-9)), F.col("ramp")
    root = (-(1 - a) + F.sqrt(F.greatest((1 - a) * (1 - a) + 4 * a * u, F.lit(0.0)))) / (2 * F.when(a != 0, a))
    return F.when((u >= 1) | (a == 0), u).otherwise(root)


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, ramps=RAMPS, max_repeats: int = MAX_REPEATS, stage: Stage | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, source, size, source_size, target, taken, starts, position of the first occurrence (taken or not), mark (a hash of the text).

    ``starts`` lists the training positions (words from the start of training) of the occurrences taken. A source's occurrences
    are taken in order until its target is reached; the last one counts only the words up to the target,
    so taken words add up to the rounded target. Null text has size 0 and is never taken, like any empty one;
    a null source is a source. Ties in the pseudo-random order go by id. An empty table gives no rows.
    """
    stage = stage or Stage(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), size.alias("size"), F.xxhash64(docs[text_col]).alias("mark"))
    rows = stage.table(rows.withColumn("order", F.shiftrightunsigned(F.xxhash64("id", "size"), 1)), "sizes")
    targets = stage.table(source_targets(rows, weights, ramps, max_repeats), "targets")
    n = rows.count()
    leaves = 1 << max(0, math.ceil(math.log2(max(1, n / LEAF))))
    laid = running_offsets(rows, ["source"], leaves)
    laid = laid.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    goal = F.round("target").cast("long")
    begins = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: k * F.col("source_size") + F.col("before"))
    begins = F.filter(begins, lambda x: (x < goal) & (F.col("size") > 0))
    taken = F.aggregate(begins, F.lit(0).cast("long"), lambda acc, x: acc + F.least(F.col("size"), goal - x))
    starts = F.transform(begins, lambda x: _position(x) * F.col("total"))
    first = _position(F.col("before").cast("double")) * F.col("total")
    return laid.select("id", "source", "size", "source_size", "target", taken.alias("taken"), starts.alias("starts"), first.alias("position"), "mark")


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The training stream: rows of ``docs``, repeated or left out as the mix says, range-sorted by position.

    A document is never cut: the occurrence in which a source reaches its target is kept whole. Rows with equal ids, sources and texts, null
    ids too, are told apart by their turn: each takes one row of the plan. A row travels as one struct, so its columns
    may have any names.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    key = ["__none", "__id", "__size", "__of", "__mark"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("__first"))
    plan = plan.select(*_row_key(F.col("id"), F.col("size"), F.col("source"), F.col("mark")), F.col("starts").alias("__starts"), F.col("position").alias("__first")).withColumn("__turn", turn)
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *_row_key(docs[id_col], size, docs[source_col], F.xxhash64(docs[text_col])), F.lit(0).alias("__first")).withColumn("__turn", turn).drop("__first")
    out = own.join(plan, [*key, "__turn"])
    return out.withColumn("__at", F.explode("__starts")).sort("__at", "__none", "__id").select("__row.*")


def _row_key(id: Column, size: Column, source: Column, mark: Column) -> list[Column]:
    """Columns without nulls that tell rows apart as far as the plan does."""
    return [id.isNull().alias("__none"), F.coalesce(id.cast("string"), F.lit("")).alias("__id"), size.alias("__size"), F.to_json(F.struct(source.alias("s"))).alias("__of"), mark.alias("__mark")]


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.sort("position", "id").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
