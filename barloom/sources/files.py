"""Files of bars and of auxiliary series: readers, archive parsers, an upserting table, an append-only table of evaluations."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.feather
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

PRICES = ("open", "high", "low", "close", "volume")
FORMATS = ("csv", "json", "parquet", "feather")
#: Names under which a time column is found, in this order.
TIMES = ("date", "time", "timestamp", "ts", "datetime", "open_time", "create_time", "calc_time")


# ---- any format ------------------------------------------------------------------------


def form_of(path: str, form: str | None = None) -> str:
    form = form or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if form not in FORMATS:
        raise ValueError(f"{form!r} is not one of {', '.join(FORMATS)}; pickles hold code and are not read")
    return form


def read_any(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """CSV (with a header, types inferred), JSON lines, Parquet or Feather, by the suffix unless ``form`` says."""
    form = form_of(path, form)
    if form == "feather":
        return feather(spark, path)
    return spark.read.csv(path, header=True, inferSchema=True) if form == "csv" else getattr(spark.read, form)(path)


def feather(spark: SparkSession, pattern: str) -> DataFrame:
    """Feather files, each read in a task. All are taken to have the columns of the first by path; what one lacks is null. Times without a zone count as UTC.

    ValueError where there is no file.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def table(blob: bytes) -> pa.Table:
        return pyarrow.feather.read_table(io.BytesIO(blob))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [from_arrow_schema(table(blob).schema).json() for blob in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string())], ["schema"])

    first = files.orderBy("path").limit(1).mapInArrow(described, "schema string").head()
    if first is None:
        raise ValueError(f"no files at {pattern!r}")
    schema = StructType.fromJson(json.loads(first["schema"]))
    target = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("content").to_pylist():
                found = table(blob)
                columns = [found.column(f.name).cast(f.type, safe=False) if f.name in found.column_names else pa.nulls(len(found), f.type) for f in target]
                yield from pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in columns], schema=target).combine_chunks().to_batches(max_chunksize=1 << 16)

    return files.mapInArrow(rows, schema)


def write_any(df: DataFrame, path: str, form: str | None = None) -> None:
    form, out = form_of(path, form), df.write.mode("overwrite")
    if form == "feather":
        raise ValueError("Feather is read only; write Parquet")
    out.csv(path, header=True) if form == "csv" else getattr(out, form)(path)


# ---- times and columns --------------------------------------------------------------------


def as_time(column: Column, kind: str) -> Column:
    """A timestamp from text, from a timestamp, or from seconds, milliseconds or microseconds since 1970, told apart by magnitude. What cannot be read is null."""
    if kind.startswith("timestamp") or kind == "date":
        return column.cast("timestamp")
    number = column.try_cast("double")
    scale = F.when(F.abs(number) >= 1e14, 1e6).when(F.abs(number) >= 1e11, 1e3).otherwise(1.0)
    read = F.timestamp_micros(F.round(number / scale * 1e6).cast("long"))
    return read if kind != "string" else F.coalesce(read, column.try_cast("timestamp"))


def find_column(columns: list[str], name: str) -> str | None:
    """The column called so, else one that starts so, else one that contains it; without regard to case, the shortest first."""
    low = sorted(((c.lower(), c) for c in columns), key=lambda x: (len(x[0]), x[0]))
    tests = (lambda c: c == name, lambda c: c.startswith(name), lambda c: name in c)
    return next((c for test in tests for lower, c in low if test(lower)), None)


def normal_bars(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(ts, open, high, low, close, volume, other columns) by time, both ends of the date range included. ValueError where a column is missing."""
    kinds = dict(df.dtypes)
    found = {p: find_column(df.columns, p) for p in PRICES}
    time = next((c for t in TIMES for c in df.columns if c.lower() == t), None)
    lacking = [p for p, c in found.items() if c is None] + ([] if time else ["a time column"])
    if lacking:
        raise ValueError(f"no {', '.join(lacking)} among {df.columns}")
    rest = [c for c in df.columns if c not in {time, *found.values()}]
    out = df.select(as_time(F.col(f"`{time}`"), kinds[time]).alias("ts"), *[F.col(f"`{c}`").try_cast("double").alias(p) for p, c in found.items()], *rest).filter("ts is not null")
    for bound, keep in ((start, F.col("ts") >= F.lit(start).cast("timestamp")), (end, F.col("ts") <= F.lit(end).cast("timestamp"))):
        out = out.filter(keep) if bound else out
    return out


def page(df: DataFrame, size: int, number: int = 0, by: str = "ts") -> DataFrame:
    """Rows number * size and on, ``size`` of them, in the order of a column (a report)."""
    return df.orderBy(by).offset(number * size).limit(size)


# ---- bar files -------------------------------------------------------------------------------


def bar_paths(folder: str, base: str, timeframe: str, market: str = "futures", quote: str = "USDT") -> list[str]:
    """Where a symbol's bars may lie, the likeliest first."""
    names = [f"{base}_{quote}_{quote}-{timeframe}-{market}", f"{base}_{quote}-{timeframe}-{market}", f"{base}{quote}-{timeframe}-{market}", f"{base}_{quote}-{timeframe}", f"{base}{quote}-{timeframe}", f"{base}-{timeframe}"]
    return [f"{folder.rstrip('/')}/{sub}{name}.{form}" for sub in (f"{market}/", "spot/", "") for name in names for form in ("parquet", "feather", "csv")]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def scan_bars(spark: SparkSession, folder: str, base: str, timeframe: str, start: str | None = None, end: str | None = None, market: str = "futures") -> DataFrame:
    """The first of ``bar_paths`` that is there, with a symbol column. FileNotFoundError if none is; ValueError if its bars span less than a minute."""
    path = next((p for p in bar_paths(folder, base, timeframe, market) if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"no bars of {base} at {timeframe} under {folder}")
    bars = normal_bars(read_any(spark, path), start, end)
    span = bars.agg((F.max("ts").cast("double") - F.min("ts").cast("double"))).head()[0]
    if span is not None and span < 60:
        raise ValueError(f"{path} spans {span} seconds")
    return bars.withColumn("symbol", F.lit(base))


def scan_many(spark: SparkSession, folder: str, bases: list[str], timeframe: str, **options) -> DataFrame:
    """One frame of the symbols whose bars can be read; the others are left out."""
    frames = []
    for base in bases:
        try:
            frames.append(scan_bars(spark, folder, base, timeframe, **options))
        except (FileNotFoundError, ValueError):
            continue
    if not frames:
        raise FileNotFoundError(f"no bars of {bases} at {timeframe} under {folder}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def inventory(spark: SparkSession, pattern: str, form: str = "parquet") -> DataFrame:
    """One row a file: file, symbol and timeframe from its name, bytes, rows, first and last time."""
    df = read_any(spark, pattern, form)
    time = next(c for t in TIMES for c in df.columns if c.lower() == t)
    rows = df.select(as_time(F.col(time), dict(df.dtypes)[time]).alias("ts"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    out = rows.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("symbol", F.split("file", "-")[0]).withColumn("timeframe", F.regexp_extract("file", r"-(\d+[mhdwM])\b", 1))


# ---- archives -----------------------------------------------------------------------------------


def zip_csv(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Rows of the CSV files inside zip archives as text columns, and ``archive``, the archive's path.

    A first line that does not start with a number is a header, whose names count; without one, ``columns`` name the fields by place. Missing fields
    are null, and files that are no archives give no rows. An archive is read whole in one task.
    """

    def rows_of(path: str, blob: bytes) -> Iterator[list]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(blob))
        except zipfile.BadZipFile:
            return
        for member in archive.namelist():
            lines = [r for r in csv.reader(io.TextIOWrapper(archive.open(member), encoding="utf-8", errors="replace")) if r]
            names = columns
            if lines and not lines[0][0].lstrip("-").replace(".", "", 1).isdigit():
                names = [n.strip().lower() for n in lines.pop(0)]
            at = [names.index(c) if c in names else None for c in columns]
            for line in lines:
                yield [path, *[line[i] if i is not None and i < len(line) else None for i in at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(rows_of(path, blob))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(columns) + 1)], ["archive", *columns])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"`{c}` string" for c in ("archive", *columns)))


#: Fixed order of the fields of an exchange's kline row.
KLINE = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore"]


def _numbers(names: list[str]) -> list[Column]:
    return [F.col(n).try_cast("double").alias(n) for n in names]


def klines(rows: DataFrame) -> DataFrame:
    """Text rows by place (``KLINE``) -> ts, prices, taker flows; these are null where the source has none."""
    have = [n if n in rows.columns else None for n in ("taker_buy_base", "taker_buy_quote")]
    takers = [F.col(n).try_cast("double").alias(n) if n else F.lit(None).cast("double").alias(m) for n, m in zip(have, ("taker_buy_base", "taker_buy_quote"), strict=True)]
    return rows.select(as_time(F.col("open_time"), "string").alias("ts"), *_numbers(list(PRICES)), *takers).filter("ts is not null")


#: Fixed names of the archive's fields and of ours.
METRICS = {"sum_open_interest": "open_interest", "count_long_short_ratio": "lsr_global_account", "count_toptrader_long_short_ratio": "lsr_top_account", "sum_toptrader_long_short_ratio": "lsr_top_position", "sum_taker_long_short_vol_ratio": "taker_buy_ratio_metrics"}


def metrics(rows: DataFrame) -> DataFrame:
    """Open interest and long/short ratios by time (create_time, else timestamp); what is no number, and fields that are not there, are null; rows without a time go."""
    time = F.coalesce(*[as_time(F.col(c), "string") for c in ("create_time", "timestamp") if c in rows.columns], F.lit(None).cast("timestamp"))
    cells = [F.col(a).try_cast("double").alias(b) if a in rows.columns else F.lit(None).cast("double").alias(b) for a, b in METRICS.items()]
    return rows.select(time.alias("ts"), *cells).filter("ts is not null")


def funding(rows: DataFrame) -> DataFrame:
    """(ts, funding_rate) from a time and a rate column under any of their usual names (fixed values); rows without either go. ValueError where no column is called so."""
    low = [x.lower() for x in rows.columns]
    time = next((c for c in ("calc_time", "fundingtime", "funding_time", "timestamp", "date") if c in low), None)
    rate = next((c for c in ("last_funding_rate", "fundingrate", "funding_rate", "rate") if c in low), None)
    if time is None or rate is None:
        raise ValueError(f"no time and rate of funding among {rows.columns}")
    kinds = {k.lower(): v for k, v in rows.dtypes}
    return rows.select(as_time(F.col(time), kinds[time]).alias("ts"), F.col(rate).try_cast("double").alias("funding_rate")).dropna()


def price_series(rows: DataFrame, kind: str) -> DataFrame:
    """Mark or index klines -> ts and {kind}_open, {kind}_high, {kind}_low, {kind}_close."""
    return rows.select(as_time(F.col("open_time"), "string").alias("ts"), *[F.col(p).try_cast("double").alias(f"{kind}_{p}") for p in PRICES[:4]]).filter("ts is not null")


# ---- series of the whole market -----------------------------------------------------------------------


def resampled(series: DataFrame, columns: list[str], seconds: int) -> DataFrame:
    """Last known value of each column in left-closed buckets, and the bucket before's where there is none: one row for every bucket from the first to the last."""
    bucket = F.floor(F.col("ts").cast("double") / seconds).cast("long")
    last = series.groupBy(bucket.alias("bucket")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns])
    ends = last.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = ends.filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("bucket")).join(last, "bucket", "left")
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one market-wide series: a row a bucket
    return grid.select(F.timestamp_seconds(F.col("bucket") * seconds).alias("ts"), *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns])


def macro(quotes: DataFrame, tickers: dict[str, str], seconds: int, percent: tuple[str, ...] = ("us10y_yield",)) -> DataFrame:
    """quotes(ts, ticker, close) -> a column for each ticker (name -> ticker), yields as shares, resampled."""
    value = {n: F.max(F.when(F.col("ticker") == t, F.col("close") / (100.0 if n in percent else 1.0))).alias(n) for n, t in tickers.items()}
    return resampled(quotes.groupBy("ts").agg(*value.values()), list(tickers), seconds)


def sentiment(vix: DataFrame, caps: DataFrame, seconds: int) -> DataFrame:
    """vix(ts, vix) and caps(ts, stable, coin) -> vix and stablecoin_supply_ratio (stable / coin), outer-joined and resampled."""
    supply = caps.select("ts", F.try_divide("stable", "coin").alias("stablecoin_supply_ratio"))
    return resampled(vix.join(supply, "ts", "outer"), ["vix", "stablecoin_supply_ratio"], seconds)


# ---- tables ------------------------------------------------------------------------------------------


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of an upserted table; null if there is none."""
    if not exists(spark, f"{path}/versions"):
        return None
    versions = spark.read.json(f"{path}/versions")
    last = versions.agg(F.max("version")).head()[0]
    return spark.read.parquet(f"{path}/version-{last:06d}")


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], latest: tuple[str, ...] = ()) -> dict[str, int]:
    """New rows over stored ones, by keys. The result is a new version beside the old; it counts once its number has been written, so a job that dies leaves
    the old one. Of rows repeated with one key in ``new`` the one with the largest ``latest`` columns stays, then the one with the largest hash, so a task
    that runs again keeps the same row. Counts of new, stored and resulting rows."""
    old = current(spark, path)
    rows = new.withColumn("__new", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), *[F.desc_nulls_last(c) for c in latest], F.xxhash64(*new.columns).desc()))
    number = 1 + (spark.read.json(f"{path}/versions").agg(F.max("version")).head()[0] if old is not None else 0)
    rows.withColumn("__turn", turn).filter("__turn = 1").drop("__turn", "__new").write.mode("overwrite").parquet(f"{path}/version-{number:06d}")
    spark.createDataFrame([(number,)], "version int").write.mode("append").json(f"{path}/versions")
    return {"new": new.count(), "stored": old.count() if old is not None else 0, "result": current(spark, path).count()}


def save_evaluation(results: DataFrame, path: str) -> None:
    """Append results(factor, ...) with the time of saving; earlier evaluations stay."""
    results.withColumn("evaluated_at", F.current_timestamp()).write.mode("append").partitionBy("factor").parquet(path)


def evaluations(spark: SparkSession, path: str, factor: str | None = None) -> DataFrame:
    """All evaluations, or those of a factor."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("factor") == factor) if factor else rows


def roll_up(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Means of measures over a factor's evaluations, their number, and the time of the last."""
    return rows.groupBy("factor").agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("evaluations"), F.max("evaluated_at").alias("last"))


def export_factors(values: DataFrame, names: list[str], path: str, form: str = "csv") -> None:
    """symbol, ts and the named factor columns."""
    write_any(values.select("symbol", "ts", *[F.col(f"`{n}`") for n in names]), path, form)
