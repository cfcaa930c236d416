"""Where a pattern matches in a text, as Spark column expressions, in time linear in the matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches summed up together: within a block one by one, then block by block. Only speed depends on it.
BLOCK = 512
_PLACES = "array<struct<start:int,end:int,found:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(items: Column) -> Column:
    """``items`` cut into arrays of at most ``BLOCK``; an empty array has none."""
    cut = lambda: F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), lambda i: F.slice(items, i + 1, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, cut()).otherwise(F.slice(F.array(items), 1, 0))


def places(text: Column, pattern: Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """Every match of ``pattern`` as an array of (start, end, found); end is exclusive. Positions are sums of ``measure``
    of what stands before: code points, unless it counts something else, like spaces. No match: an empty array."""
    none = F.array().cast(_PLACES)

    def summed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(measure(g).cast("int").alias("g")))
        both = F.filter(F.zip_with(hits, gaps, lambda m, g: F.struct(m.alias("m"), g["g"].alias("g"))), lambda x: x["m"].isNotNull())
        return let(both, lambda b: let(F.transform(F.sequence(F.lit(0), F.size(b) - 1, F.lit(BLOCK)), lambda i: within(F.slice(b, i + 1, F.lit(BLOCK)))), across))

    def within(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["g"]
            end = start + measure(x["m"]).cast("int")
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("found")))).alias("out"))

        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def across(blocks: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        before = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        moved = lambda b, n: F.transform(b["out"], lambda p: F.struct((p["start"] + n).alias("start"), (p["end"] + n).alias("end"), p["found"].alias("found")))
        return F.flatten(F.zip_with(blocks, before, moved))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, summed(hits)).otherwise(none))
