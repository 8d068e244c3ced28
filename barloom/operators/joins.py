"""Joining and aligning series: chains of as-of joins, outer merges, intersections, wide tables, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sqlop import SqlOp


def asof(main: DataFrame, extra: DataFrame, by: str = "symbol", ts: str = "ts", prefix: str = "extra") -> DataFrame:
    """``main`` with the columns of the latest ``extra`` row at or before each row, that row's nulls included.

    Of extra rows with one (by, ts) the one with the largest values stays. Columns that ``main`` has already are named {prefix}_{column}. One
    union and one window over (by, ts), so no range join and no row is copied; rows with a null key meet none.
    """
    given = [c for c in extra.columns if c not in (by, ts)]
    names = {c: f"{prefix}_{c}" if c in main.columns else c for c in given}
    right = extra.groupBy(by, ts).agg(F.max(F.struct(*given)).alias("__row"))
    right = right.select(F.col(by).alias("__by"), F.col(ts).alias("__ts"), F.lit(0).alias("__side"), "__row", F.lit(None).cast(main.schema.simpleString()).alias("__main"))
    left = main.select(F.col(by).alias("__by"), F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema["__row"].dataType).alias("__row"), F.struct(*main.columns).alias("__main"))
    upto = Window.partitionBy("__by").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = right.unionByName(left).withColumn("__row", F.last("__row", ignorenulls=True).over(upto)).filter("__side = 1")
    found: list[Column] = [F.when(F.col("__by").isNotNull() & F.col("__ts").isNotNull(), F.col(f"__row.{c}")).alias(n) for c, n in names.items()]
    return met.select("__main.*", *found)


def numeric(df: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The key columns and those that hold numbers."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(*keys, *[c for c, kind in df.dtypes if c not in keys and (kind in kinds or kind.startswith("decimal"))])


def asof_market(main: DataFrame, extra: DataFrame, ts: str = "ts", prefix: str = "extra") -> DataFrame:
    """As ``asof`` for a series of the whole market, without a symbol: each row meets the latest ``extra`` row at or before its time, nulls of that row included.

    Only the distinct times of ``main`` are ordered, day by day; what a day inherits comes from a table of one row a day, and the rows of ``main`` meet their
    time by an equal key. Of extra rows with one time the one with the largest values stays; rows with a null time meet none.
    """
    given = [c for c in extra.columns if c != ts]
    names = {c: f"{prefix}_{c}" if c in main.columns else c for c in given}
    right = extra.filter(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("__ts")).agg(F.max(F.struct(*given)).alias("__row"))
    asked = main.select(F.col(ts).alias("__ts")).filter("__ts is not null").distinct()
    marks = right.withColumn("__side", F.lit(0)).unionByName(asked.withColumn("__side", F.lit(1)), allowMissingColumns=True).withColumn("__day", F.col("__ts").cast("date"))
    in_day = Window.partitionBy("__day").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    inherited = marks.groupBy("__day").agg(F.max_by("__row", F.when(F.col("__side") == 0, F.col("__ts"))).alias("__last")).select("__day", F.last("__last", ignorenulls=True).over(before).alias("__old"))
    met = marks.withColumn("__row", F.last("__row", ignorenulls=True).over(in_day)).filter("__side = 1").join(inherited, "__day").select("__ts", F.coalesce("__row", "__old").alias("__row"))
    return main.join(met, F.col(ts) == F.col("__ts"), "left").select(*[main[c] for c in main.columns], *[F.col(f"__row.{c}").alias(n) for c, n in names.items()])


def join_extras(bars: DataFrame, extras: dict[str, DataFrame]) -> DataFrame:
    """A chain of as-of joins (name -> symbol, ts, columns; without symbol where a series is of the whole market), and basis = (mark - index) / index, or
    (close - index) / index where there is no mark."""

    def step(df: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, extra = item
        return asof(df, numeric(extra), prefix=name) if "symbol" in extra.columns else asof_market(df, numeric(extra, ("ts",)), prefix=name)

    out = reduce(step, extras.items(), bars)
    if "index_close" not in out.columns:
        return out
    price = F.coalesce("mark_close", "close") if "mark_close" in out.columns else F.col("close")
    return out.withColumn("basis", F.try_divide(price - F.col("index_close"), F.col("index_close")))


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Outer merge of frames with different value columns on common keys, a row a key. Keys are unique in each frame."""
    return reduce(lambda a, b: a.join(b, keys, "outer"), frames)


def common_times(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that all frames have."""
    met = reduce(DataFrame.unionByName, [f.select(*keys).distinct().withColumn("__from", F.lit(i)) for i, f in enumerate(frames)])
    return met.groupBy(*keys).agg(F.count_distinct("__from").alias("__n")).filter(F.col("__n") == len(frames)).drop("__n")


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """long(symbol, ts, name, value) -> a column for each of the given names, a row for each (symbol, ts) that any of them has."""
    return long.filter(F.col("name").isin(names)).groupBy("symbol", "ts").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def align(wide_factors: DataFrame, returns: DataFrame, names: list[str], least: int = 10) -> DataFrame:
    """Rows with at least half of the factors and a return, of symbols that have at least ``least`` such rows."""
    known = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    rows = wide_factors.join(returns.filter("ret is not null"), ["symbol", "ts"]).filter(known * 2 >= len(names))
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("__n") >= least).drop("__n")


#: Grid of all symbols and the dates that at least $share of them have; holes take the symbol's value before, else after, else 0.
GRID = SqlOp(
    """WITH u AS (SELECT count(DISTINCT symbol) AS m FROM #bars), n AS (SELECT ts, count(DISTINCT symbol) AS k FROM #bars GROUP BY ts), d AS (SELECT ts FROM n JOIN u ON k >= $share * m),
s AS (SELECT DISTINCT symbol FROM #bars), f AS (SELECT s.symbol, d.ts, b.close, b.volume FROM d JOIN s ON true LEFT JOIN #bars AS b ON b.symbol = s.symbol AND b.ts = d.ts),
g AS (SELECT symbol, ts, @IGN(close) OVER w AS c, @IGN(volume) OVER w AS v, @FIRST(close) OVER x AS nc, @FIRST(volume) OVER x AS nv FROM f
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, CAST(ts AS $string) AS ts, round(coalesce(c, nc, 0), 4) AS close, coalesce(v, nv, 0) AS volume FROM g""",
    share="0.8",
    string="STRING",
)
