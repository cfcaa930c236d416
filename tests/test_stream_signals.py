"""Signals of a stream against the batch query, with bars that are mended while they wait."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barlake.operators import backtest
from barlake.plans import queries as plans
from barlake.streaming.signals import stream_signals
from tests.compare import close, of_spark

SF = "/root/testdata/sf0.01"
_COLUMNS = ["symbol", "open_time", "open", "high", "low", "close", "version"]
_BLOCK = 4 * 3_600_000


def _run(spark, path, schema, name: str, **options) -> list[tuple]:
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/bars/*")
    made = stream_signals(source, **options)
    made.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"file://{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _end(spark, schema, at: int):
    """A bar of another symbol that moves the watermark past all others."""
    return spark.createDataFrame([("~end", at, 1.0, 1.0, 1.0, 1.0, 0)], schema)


@pytest.mark.parametrize("mended", [False, True])
def test_stream_gives_the_rows_of_the_batch(spark, tmp_path, mended):
    """Five batches; ``mended``: the last high bar of a batch comes with wrong prices and again, right, with the next one."""
    b = plans.bars(spark, SF, "15m").withColumn("version", F.lit(1).cast("long")).select(*_COLUMNS).cache()
    first, last = b.agg(F.min("open_time"), F.max("open_time")).first()
    cuts = [first + (last + 1 - first) * i // 5 for i in range(6)]
    for i in range(5):
        part = b.where(F.col("open_time").between(cuts[i], cuts[i + 1] - 1))
        if mended:
            wrong = part.where(F.col("open_time") >= cuts[i + 1] - _BLOCK).withColumns({"close": F.col("close") * 1.5, "high": F.col("high") * 1.6, "version": F.lit(0).cast("long")})
            before = b.where(F.col("open_time").between(cuts[i] - _BLOCK, cuts[i] - 1))
            part = part.where(F.col("open_time") < cuts[i + 1] - _BLOCK).union(wrong if i < 4 else part.where(F.col("open_time") >= cuts[i + 1] - _BLOCK)).union(before)
        part.coalesce(1).write.parquet(f"file://{tmp_path}/bars/{i}")
    _end(spark, b.schema, last + 40 * _BLOCK).coalesce(1).write.parquet(f"file://{tmp_path}/bars/5")
    found = _run(spark, tmp_path, b.schema, f"signals_{mended}".lower(), late="12 hours", order="version", hours=24, **plans.LOOSE)
    (names, ours), (_, theirs) = of_spark(found), of_spark(backtest.signals(backtest.setups(*plans.frames(spark, SF, "15m", "1h", "4h").values(), **plans.LOOSE), hours=24))
    assert names == sorted(["symbol", "open_time", "side", "entry", "stop_loss", "take_profit", "deadline"])
    assert len(ours) == len(theirs) > 0 and all(map(close, ours, theirs))


def test_odd_bars_stop_nothing(spark, tmp_path):
    """Nulls in any column, repeated rows, rows behind the watermark and an empty batch: no signal, no failure."""
    schema = "symbol string, open_time long, open double, high double, low double, close double, version long"
    flat = [("a", i * 900_000, 1.0, 1.0, 1.0, 1.0, 0) for i in range(64)]
    odd = [(None, 0, 1.0, 1.0, 1.0, 1.0, 0), ("a", None, 1.0, 1.0, 1.0, 1.0, 0), ("a", 0, None, 1.0, 1.0, 1.0, None), ("a", 0, 1.0, 1.0, 1.0, 1.0, None)]
    for i, rows in enumerate([[*flat, *flat, *odd], [], [("~end", 10**9, 1.0, 1.0, 1.0, 1.0, 0)], flat[:3]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/bars/{i}")
    assert _run(spark, tmp_path, spark.createDataFrame([], schema).schema, "signals_odd", swing=4).count() == 0
