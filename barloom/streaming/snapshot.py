"""Live bars with the latest row of each side series, and the latest bars of each symbol, held as keyed state with event-time timers.

A symbol's state is what waits for the watermark, the last row of each side series and its latest bars: its size depends on the delay that is allowed and
on ``keep``, not on the length of the stream. Rows are settled in the order of their times once the watermark has passed them, so the result is that of the batch
as-of join, whatever order rows of a batch come in.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .bars import run_once, shared_folder

#: The state store that keyed state with timers needs.
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "bar"


@contextmanager
def keyed_state(spark: SparkSession):
    """The session's state store while a stream with keyed state runs."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was) if was else spark.conf.unset(_PROVIDER)


class LatestRows(StatefulProcessor):
    """Rows (symbol, at, side, value) of one symbol -> its bars with the last value of each side at or before them and the values of the last ``keep`` bars."""

    def __init__(self, sides: list[str], keep: int):
        self.names, self.keep = sides, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, side string, value double")
        self.last = handle.getMapState("last", "side string", "at long, value double")
        self.bars = handle.getListState("bars", "at long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [(int(a), str(s), None if pd.isna(v) else float(v)) for pdf in rows for a, s, v in zip(pdf["at"], pdf["side"], pdf["value"], strict=True) if a > passed]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(-(-min(a for a, _, _ in fresh) // 1000))
        yield pd.DataFrame(columns=["symbol", "at", "value", "sides", "recent"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get() if self.waiting.exists() else [], key=lambda r: (r[0], r[1] == BAR, r[1]))
        due, rest = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        if due:
            yield self._settled(key[0], due)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()

    def _settled(self, symbol: str, due: list[tuple]) -> pd.DataFrame:
        last = {name: self.last.getValue((name,)) for name in self.names if self.last.containsKey((name,))}
        bars = list(self.bars.get()) if self.bars.exists() else []
        out, moved = [], set()
        for at, side, value in due:
            if side != BAR:
                last[side] = (at, value)
                moved.add(side)
                continue
            bars = [*bars, (at, value)][-self.keep :]
            out.append((symbol, at, value, [last[n][1] if n in last else None for n in self.names], [b[1] for b in bars]))
        for side in moved:
            self.last.updateValue((side,), last[side])
        if bars:
            self.bars.put(bars)
        return pd.DataFrame(out, columns=["symbol", "at", "value", "sides", "recent"])

    def close(self) -> None:
        pass


def latest_rows(rows: DataFrame, sides: list[str], keep: int = 200, late: str = "2 hours") -> DataFrame:
    """rows(symbol, ts, side, value), a stream -> (symbol, ts, close, sides..., recent), a row for each bar (side ``bar``) that the watermark has passed.

    A side's value is that of its last row at or before the bar, null values included; of rows of one side and time the last to come counts. Rows that come
    more than ``late`` behind the newest of the stream are left out. Run it with ``keyed_state`` and output mode append.
    """
    keyed = rows.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "side", F.col("value").cast("double").alias("value"))
    found = keyed.filter("symbol is not null and ts is not null").withWatermark("ts", late).groupBy("symbol")
    found = found.transformWithStateInPandas(LatestRows(sides, keep), "symbol string, at long, value double, sides array<double>, recent array<double>", "append", "eventtime")
    return found.select("symbol", F.timestamp_micros("at").alias("ts"), F.col("value").alias("close"), *[F.col("sides")[i].alias(s) for i, s in enumerate(sides)], "recent")


def replay(rows: DataFrame, sides: list[str], keep: int = 200, late: str = "2 hours") -> DataFrame:
    """``latest_rows`` of a table, as if its rows came as a stream: stored in the shared folder, streamed from there, and the result read back."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/barloom/replay-{uuid.uuid4().hex}"
    rows.select("symbol", "ts", "side", "value").write.parquet(f"{folder}/in")
    with keyed_state(spark):
        return run_once(latest_rows(spark.readStream.schema(rows.select("symbol", "ts", "side", "value").schema).parquet(f"{folder}/in"), sides, keep, late), ["symbol", "ts"], f"{folder}/out", mode="append")
