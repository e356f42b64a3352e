"""Sums of vectors by key: within each task first, then where a key's sums meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Numbers that a task holds before it passes its sums on.
HELD = 2_000_000

Keys = list[tuple]


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def lists(values: np.ndarray) -> pa.Array:
    """Rows as arrays."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(values.ravel()))


def added(keys: Keys, values: np.ndarray) -> tuple[Keys, np.ndarray]:
    """Distinct keys, in order of appearance, and the sums of their rows."""
    if not keys:
        return [], values
    index: dict[tuple, int] = {}
    at = np.fromiter((index.setdefault(k, len(index)) for k in keys), np.int64, len(keys))
    order = np.argsort(at, kind="stable")
    return list(index), np.add.reduceat(values[order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)


class Held:
    """Sums by key that a task holds."""

    def __init__(self) -> None:
        self.sums: dict[tuple, np.ndarray] = {}
        self.width = 0

    def add(self, keys: Keys, values: np.ndarray) -> None:
        self.width = values.shape[1] if len(keys) else self.width
        for key, row in zip(*added(keys, values), strict=True):
            self.sums[key] = self.sums[key] + row if key in self.sums else row

    @property
    def full(self) -> bool:
        return len(self.sums) * self.width > HELD

    def told(self, names: Sequence[str], kinds: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if self.sums:
            yield batch_of(names, kinds, list(self.sums), {"v": lists(np.array(list(self.sums.values())))})
            self.sums.clear()


def batch_of(names: Sequence[str], kinds: Sequence[pa.DataType], keys: Keys, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    first = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
    return pa.record_batch([*first, *columns.values()], names=[*names, *columns])


def kinds_of(df: DataFrame, keys: Sequence[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[k].dataType) for k in keys]


def ddl_of(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def partly_summed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and v, each task's sums of v (arrays of one length)."""
    names, kinds = list(keys), kinds_of(df, keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            held.add(list(zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True)), matrix(batch.column(len(names))))
            if held.full:
                yield from held.told(names, kinds)
        yield from held.told(names, kinds)

    return df.select(*names, "v").mapInArrow(add, f"{ddl_of(df, keys)}, v array<double>")


def met(parts: DataFrame, keys: Sequence[str], finish: Callable[[Keys, np.ndarray], dict[str, pa.Array]] | None = None, ddl: str = "v array<double>", together: int | None = None) -> DataFrame:
    """keys and the columns that finish makes of their summed vectors; the sums themselves unless given.

    Parts of a key meet in one task, which holds one batch and one sum. With together, finish
    gets all keys at once that agree in so many of the first.
    """
    names, kinds = list(keys), kinds_of(parts, keys)
    finish = finish or (lambda _, sums: {"v": lists(sums)})
    first = together or len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Keys = []
        rest = np.empty((0, 0))
        for batch in batches:
            if batch.num_rows:
                own = list(zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True))
                values = matrix(batch.column(len(names)))
                found, sums = added(last + own, np.vstack([rest, values]) if last else values)
                open_ = next(i for i, k in enumerate(found) if k[:first] == found[-1][:first])
                if open_:
                    yield batch_of(names, kinds, found[:open_], finish(found[:open_], sums[:open_]))
                last, rest = found[open_:], sums[open_:]
        if last:
            yield batch_of(names, kinds, last, finish(last, rest))

    dealt = parts.select(*names, "v").repartition(*names[:first]).sortWithinPartitions(*names)
    return dealt.mapInArrow(add, f"{ddl_of(parts, keys)}, {ddl}")


@contextmanager
def rows_at_a_time(spark: SparkSession, n: int) -> Iterator[None]:
    """Python tasks that run inside get n rows at a time, for rows that hold lists; the session's own number comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)
