"""Alerts of a stream come once; their line."""

from __future__ import annotations

import datetime

from barlake.streaming import bars as streams

_ROWS = "symbol string, side string, ts timestamp, stop_loss double, take_profit double"


def test_alerts_come_once(spark, tmp_path):
    at = [datetime.datetime(2024, 1, 1, h) for h in (0, 1, 2)]
    batches = [[("a", "long", at[0]), ("a", "long", at[0]), ("b", "short", at[0])], [("a", "long", at[0]), ("a", "short", at[0]), ("b", "short", at[1])], [("b", "short", at[1]), ("b", "short", at[2])]]
    for i, rows in enumerate(batches):  # one file a batch; signals of a batch are sent again with the next one
        spark.createDataFrame([(*r, 1.0 + i, 2.0) for r in rows], _ROWS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/signals")
    source = spark.readStream.schema(_ROWS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/signals")
    once = streams.distinct_alerts(source)
    once.writeStream.outputMode("append").format("memory").queryName("alerts_once").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    found = sorted((r.symbol, r.side, r.ts) for r in spark.table("alerts_once").collect())
    assert found == sorted({r for rows in batches for r in rows})


def test_line_of_an_alert(spark):
    made = spark.createDataFrame([("abc", "long", datetime.datetime(2024, 1, 1, 12, 15), 0.5, 2.0), ("x", None, None, 1.0, 1.0)], _ROWS)
    lines = [r[0] for r in made.select(streams.message()).collect()]
    assert lines[0].startswith("ABC LONG at 2024-01-01") and lines[0].endswith("stop 0.5000, target 2.0000")
    assert lines[1].startswith("X null")
