"""A state carried along each symbol's rows, for what has no windowed form: the next row depends on what this one made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barlake.shipping import ship

_TYPES = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}


def walk(rows: DataFrame, order: str, inputs: list[str], start: Callable[[], object], step: Callable[..., tuple], made: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``made`` (name: double, long or boolean).

    ``step(state, *inputs)`` gives (new state, *values) for each row of a symbol, in ``order``. Rows are dealt by symbol
    and sorted, then read batch by batch with the state kept in between: a symbol of any length needs one batch of memory.
    Nulls come as None, and None gives null. An empty table gives an empty table.
    """
    ship(rows.sparkSession)
    source = rows.select(*[c for c in rows.columns if c not in made])
    schema = source.schema
    for name, kind in made.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None  # no symbol yet
        for b in batches:
            out: list[tuple] = []
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("symbol", *inputs)]
            for symbol, *values in zip(*columns, strict=True):
                if symbol != now:
                    now, state = symbol, start()
                state, *found = step(state, *values)
                out.append(tuple(found))
            each = list(zip(*out, strict=True)) if out else [[] for _ in made]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, _TYPES[k]) for x, k in zip(each, made.values(), strict=True)]], [*b.schema.names, *made])

    return source.repartition("symbol").sortWithinPartitions("symbol", order).mapInArrow(run, schema)
