"""Ordered state per key, folded over each key's events.

The folds stream: rows are dealt out by key, sorted, and read batch by batch with the state of
one key in hand, so that a key with very many events needs no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folded(events: DataFrame, key: str, order: list[str], start: Callable[[], list], step: Callable, name: str) -> DataFrame:
    """``events`` with the boolean column ``name``: what ``step(state, *row)`` says of each row of a key in order."""
    columns = events.columns

    def run(batches):
        current, state, first = None, start(), True
        for batch in batches:
            out = []
            for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns if c != key)):
                if first or k != current:
                    current, state, first = k, start(), False
                out.append(step(state, *row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, name])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in events.dtypes) + f", `{name}` boolean"
    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def rate_limited(events: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """(key, order, allowed): an event is allowed if none was allowed within so many seconds before it."""

    def step(last: list, t: int, _: int) -> bool:
        ok = not last or t - last[0] >= seconds * 1_000_000
        if ok:
            last[:] = [t]
        return ok

    rows = events.select(key, F.unix_micros(ts).alias("__t"), order)
    return _folded(rows, key, ["__t", order], list, step, "allowed").drop("__t")


def login_guarded(events: DataFrame, key: str, ts: str, order: str, failed: str, seconds: int, limit: int) -> DataFrame:
    """(key, order, locked): attempts while locked are refused; failures count within a half-open window, success clears them.

    A key's state is at most ``limit`` times.
    """

    def step(kept: list, t: int, _: int, f: bool) -> bool:
        kept[:] = [x for x in kept if x > t - seconds * 1_000_000]
        if len(kept) >= limit:
            return True
        kept[:] = [*kept, t] if f else []
        return False

    rows = events.select(key, F.unix_micros(ts).alias("__t"), order, failed)
    return _folded(rows, key, ["__t", order], list, step, "locked").select(key, order, "locked")


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """The number of failures in a row up to each event (0 at a success)."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    marked = events.withColumn("__island", island).withColumn("__failed", failed)
    own = Window.partitionBy(key, "__island").orderBy(*order)
    return marked.withColumn("run", F.sum(F.col("__failed").cast("int")).over(own)).drop("__island", "__failed")


def rolling_mean(events: DataFrame, key: str, order: list[str], value: str, last: int = 10) -> DataFrame:
    """The mean of the last values of a key up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    return events.withColumn("rolling", F.avg(value).over(w))
