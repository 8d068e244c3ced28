"""Keyed state over a stream in several batches against the batch as-of join."""

import random

from barloom.streaming.bars import run_once
from barloom.streaming.snapshot import keyed_state, latest_rows

SCHEMA = "symbol string, ts timestamp_ntz, side string, value double"


def test_stream_in_three_batches_with_rows_out_of_order_and_late(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = []
    for symbol in ("a", "b"):
        for h in range(60):
            rows.append((symbol, start + timedelta(hours=h), "bar", float(h)))
            if h % 3 == 1:
                rows.append((symbol, start + timedelta(hours=h, minutes=-20), "funding", None if h == 31 else h / 10))
            if symbol == "a" and h % 2 == 0:
                rows.append((symbol, start + timedelta(hours=h), "mark", h + 0.5))
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: latest_rows(spark.readStream.schema(SCHEMA).parquet(source), ["funding", "mark"], keep=5, late="90 minutes")
    with keyed_state(spark):
        for lo, hi in ((0, 20), (20, 21), (21, 60)):
            part = [r for r in rows if start + timedelta(hours=lo) - timedelta(minutes=30) < r[1] + timedelta(minutes=0) <= start + timedelta(hours=hi) - timedelta(minutes=30)]
            if lo == 21:
                part.append(("a", start, "mark", 999.0))  # far behind the watermark: left out
            rng.shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            found = run_once(stream(), ["symbol", "ts"], folder, mode="append")
    found = {(r["symbol"], r["ts"].replace(tzinfo=None)): r for r in found.collect()}
    end = max(r[1] for r in rows if r[1] <= start + timedelta(hours=60) - timedelta(minutes=30)) - timedelta(minutes=90)
    bars = sorted((s, t, v) for s, t, side, v in rows if side == "bar" and t <= end)
    assert len(found) == len(bars) > 100
    for symbol, ts, close in bars:
        r = found[symbol, ts]
        for side in ("funding", "mark"):
            known = sorted((t, v) for s, t, x, v in rows if s == symbol and x == side and t <= ts)
            assert r[side] == (known[-1][1] if known else None)
        closes = [v for s, t, v in bars if s == symbol and t <= ts][-5:]
        assert r["close"] == close and r["recent"] == closes
