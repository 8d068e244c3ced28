"""Which symbols may be traded on each date: market rank, mean traded value, listing age and lists of excluded names, all as they stood on that date.

Reference tables carry validity ranges, from ``valid_from`` (null: always) up to but without ``valid_to`` (null: still valid). Every join is on equal keys:
a range becomes the dates of the given list that lie in it, and "one name contains the other" becomes equality with one of the longer name's parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof


@dataclass(frozen=True)
class Rules:
    """``kinds`` are the lists that exclude a name, the first match being its reason; ``prefixes`` are what markets put before a name that trades in thousands."""

    max_rank: int = 200
    min_volume: float = 1_000_000.0
    min_age_days: int = 90
    volume_days: int = 30
    kinds: tuple[str, ...] = ("stable", "blacklist")
    prefixes: tuple[str, ...] = ("1000", "10000", "100000")


def valid_at(ranges: DataFrame, dates: list[date]) -> DataFrame:
    """A row for each of the dates on which a row is valid, as ``as_of``. The list is a parameter, so no date table is joined."""
    days = F.array(*[F.lit(d) for d in sorted(set(dates))]) if dates else F.array().cast("array<date>")
    held = F.filter(days, lambda d: (F.col("valid_from").isNull() | (d >= F.col("valid_from").cast("date"))) & (F.col("valid_to").isNull() | (d < F.col("valid_to").cast("date"))))
    return ranges.withColumn("as_of", F.explode(held)).drop("valid_from", "valid_to")


def _parts(name: str, least: int) -> Column:
    """The distinct substrings of a column from a length on."""
    inner = f"if(length({name}) - i + 1 >= {least}, transform(sequence({least}, length({name}) - i + 1), n -> substring({name}, i, n)), array())"
    return F.expr(f"if(length({name}) >= {least}, array_distinct(flatten(transform(sequence(1, length({name})), i -> {inner}))), array())")


def resolve(names: DataFrame, markets: DataFrame, aliases: DataFrame | None = None, prefixes: tuple[str, ...] = Rules.prefixes) -> DataFrame:
    """names(base, coin_id) -> base, coin_id, symbol: the market under which a name trades; null where there is none.

    In this order: the name itself, behind one of the prefixes, its alias (alone and prefixed), the alias of its coin_id, a market called like the coin_id,
    and last the only market whose name contains, or is contained in, a name or coin_id of three letters or more. Case does not matter. markets(symbol);
    aliases(name, alias). Null and empty names meet nothing; repeated rows give one.
    """
    given = names.select("base", "coin_id").distinct().withColumn("u", F.upper("base")).withColumn("c", F.upper("coin_id"))
    listed = markets.filter(F.length("symbol") > 0).groupBy(F.upper("symbol").alias("market")).agg(F.min("symbol").alias("symbol"))
    if aliases is None:
        met = given.withColumn("a", F.lit(None).cast("string")).withColumn("b", F.lit(None).cast("string"))
    else:
        known = aliases.groupBy(F.upper("name").alias("u")).agg(F.max(F.upper("alias")).alias("a"))
        met = given.join(known, "u", "left").join(known.select(F.col("u").alias("c"), F.col("a").alias("b")), "c", "left")
    called = [F.concat(F.lit(p), F.col(x)) for x in ("u", "a", "b") for p in ("", *prefixes)]
    tried = met.select("base", "coin_id", "u", "c", F.posexplode(F.array(*called, F.col("c"))).alias("turn", "market")).filter(F.length("market") > 0)
    first = tried.join(listed, "market", "left").groupBy("base", "coin_id", "u", "c").agg(F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("turn"))).alias("symbol"))

    open_names = first.filter("symbol is null").select("base", "coin_id", F.explode(F.array_distinct(F.array("u", "c"))).alias("word")).filter(F.length("word") >= 3)
    inside = open_names.join(listed.select(F.explode(_parts("market", 3)).alias("word"), "symbol"), "word")
    around = open_names.withColumn("market", F.explode(_parts("word", 1))).join(listed, "market")
    hits = inside.select("base", "coin_id", "symbol").unionByName(around.select("base", "coin_id", "symbol"))
    only = hits.groupBy("base", "coin_id").agg(F.min("symbol").alias("low"), F.max("symbol").alias("high")).filter("low = high")
    here = [F.col(f"g.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ("base", "coin_id")]
    sure = first.select("base", "coin_id", "symbol").alias("g").join(only.alias("o"), reduce(lambda a, b: a & b, here), "left").select("g.base", "g.coin_id", F.coalesce("g.symbol", "o.low").alias("symbol"))
    return sure


def universe(bars: DataFrame, ranks: DataFrame, dates: list[date], rules: Rules = Rules(), exclusions: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """bars(symbol, ts, close, volume), ranks(base, coin_id, rank, valid_from, valid_to), exclusions(base, kind, valid_from, valid_to), aliases(name, alias)
    -> as_of, base, coin_id, rank, symbol, avg_volume, first_day, age_days, reason for each date and each name with a rank up to the highest.

    ``reason`` is null for members, else a kind of exclusion, ``market``, ``volume`` or ``age``, the first that holds. Traded value of a day: its last close by
    its summed volume; the mean is over the symbol's last ``volume_days`` days with bars up to the date, that day included; age counts from its first bar.
    Rows with a null name, rank, symbol or time take no part. A symbol's bars are summed to days before they are ordered.
    """
    scanned = valid_at(ranges=ranks.filter(F.col("base").isNotNull() & (F.col("rank") <= rules.max_rank)), dates=dates).select("as_of", "base", "coin_id", "rank")
    daily = bars.filter("symbol is not null and ts is not null").groupBy("symbol", F.col("ts").cast("date").alias("ts")).agg(
        F.max(F.when(F.col("close").isNotNull(), F.struct(F.col("ts").alias("t"), "close"))).alias("last"), F.sum("volume").alias("volume"))
    order = Window.partitionBy("symbol").orderBy("ts")
    stats = daily.select("symbol", "ts", F.avg(F.col("last.close") * F.col("volume")).over(order.rowsBetween(1 - rules.volume_days, 0)).alias("avg_volume"), F.first("ts").over(order).alias("first_day"))

    named = resolve(scanned, bars.select("symbol").distinct(), aliases, rules.prefixes).withColumnRenamed("base", "__base").withColumnRenamed("coin_id", "__coin")
    rows = scanned.join(named, F.col("base").eqNullSafe(F.col("__base")) & F.col("coin_id").eqNullSafe(F.col("__coin")), "left").drop("__base", "__coin")
    rows = rows.withColumn("__name", F.upper("base"))
    if exclusions is not None and rules.kinds:
        place = F.array_position(F.array(*[F.lit(k) for k in rules.kinds]), F.col("kind"))
        barred = valid_at(exclusions.filter(F.col("kind").isin(*rules.kinds)), dates).groupBy("as_of", F.upper("base").alias("__name")).agg(F.min_by("kind", place).alias("__barred"))
        rows = rows.join(barred, ["as_of", "__name"], "left")
    else:
        rows = rows.withColumn("__barred", F.lit(None).cast("string"))
    # names without a market each have a key of their own, so they do not meet in one task
    keyed = rows.withColumn("__key", F.coalesce("symbol", F.concat(F.lit("\0"), "base"))).withColumnRenamed("as_of", "ts").drop("__name")
    met = asof(keyed, stats.withColumnRenamed("symbol", "__key"), by="__key")
    age = F.date_diff("ts", "first_day")
    reason = (
        F.when(F.col("__barred").isNotNull(), F.col("__barred"))
        .when(F.col("symbol").isNull(), "market")
        .when(F.col("avg_volume").isNull() | (F.col("avg_volume") < rules.min_volume), "volume")
        .when(age.isNull() | (age < rules.min_age_days), "age")
    )
    return met.select(F.col("ts").alias("as_of"), "base", "coin_id", "rank", "symbol", "avg_volume", "first_day", age.alias("age_days"), reason.alias("reason"))


def counts(found: DataFrame) -> DataFrame:
    """as_of, reason (``passed`` for members), n."""
    return found.groupBy("as_of", F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def members_only(bars: DataFrame, found: DataFrame, dates: list[date]) -> DataFrame:
    """Bars whose symbol was a member on the latest of the dates up to the bar's day, with that date as ``as_of``; bars before the first date go."""
    days = F.array(*[F.lit(d) for d in sorted(set(dates))])
    day = F.col("ts").cast("date")
    upto = F.filter(days, lambda d: d <= day)
    dated = bars.withColumn("as_of", F.when(F.size(upto) > 0, F.element_at(upto, -1)))
    return dated.join(found.filter("reason is null").select("as_of", "symbol").distinct(), ["as_of", "symbol"], "left_semi")
