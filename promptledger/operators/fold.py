"""Ordered folds for state that no window function can express, in bounded memory.

Rows are dealt by key and sorted, and each partition streams through a fold that keeps one key's state at a time: no
group is collected, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Output rows of a batch.
ROWS = 5000


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str], start: Callable[[tuple], Any],
                 step: Callable[[Any, dict], tuple[Any, list[tuple]]], schema: T.StructType, finish: Callable[[tuple, Any], list[tuple]] | None = None) -> DataFrame:
    """Fold the rows of each key in order. ``step(state, row)`` gives the next state and any output rows, ``finish`` the
    rows that a key's last state leaves. Rows come as dicts of ``columns``."""
    names, n, cols = list(columns), len(keys), list(keys)
    out_schema = to_arrow_schema(schema)

    def run(batches):
        held: list[tuple] = []

        def flush():
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out_schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=out_schema)

        key, state = None, None
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key is None or values[:n] != key:
                    if key is not None and finish:
                        held += finish(key, state)
                    key = values[:n]
                    state = start(key)
                state, rows = step(state, dict(zip(names, values[n:], strict=True)))
                held += rows
                if len(held) >= ROWS:
                    yield flush()
                    held = []
        if key is not None and finish:
            held += finish(key, state)
        if held:
            yield flush()

    dealt = df.repartition(*cols).sortWithinPartitions(*cols, *order)
    return dealt.select(*cols, *[dealt[c].alias(f"_{c}") for c in names]).mapInArrow(run, schema)
