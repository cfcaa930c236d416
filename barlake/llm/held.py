"""Tables that a Python worker keeps from one task to the next, of one kind at a time: workers outlive the stages that fill
such tables, and in a pipeline the tables of all stages would add up beside the executor's heap."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[str, Any] = {}


def held(kind: str, make: Callable[[], Any]) -> Any:
    """This worker's table of ``kind``, made if it holds none; those of other kinds go, and their memory is given back."""
    if kind not in _held:
        _held.clear()
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()
        _held[kind] = make()
    return _held[kind]
