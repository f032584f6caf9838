"""Feeding a training loop: a bounded shuffle buffer over rows as they come, batches, and prefetching.

Rows are not sorted and not held: at most the buffer's rows, the batches that wait to be taken, and
an Arrow batch are in memory. The order depends on the seed and on the order in which rows come.
"""

from __future__ import annotations

import queue
import random
import threading
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, islice
from typing import TypeVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

X = TypeVar("X")
# Rows of the buffer and of a batch.
BUFFER, BATCH = 2048, 32


def shuffled(rows: Iterable[X], buffer: int = BUFFER, seed: int | None = None) -> Iterator[X]:
    """Rows by way of a buffer: once it is full, one of its places is drawn each time, its row goes out
    and the next one that comes takes the place; at the end, what is left goes out by the same draw."""
    rows, luck = iter(rows), random.Random(seed)
    held = list(islice(rows, max(1, buffer)))
    for row in rows:
        at = luck.randrange(len(held))
        held[at], row = row, held[at]
        yield row
    while held:
        at = luck.randrange(len(held))
        held[at], held[-1] = held[-1], held[at]
        yield held.pop()


def prefetched(rows: Iterable[X], ahead: int = 2) -> Iterator[X]:
    """The same, got ready by a thread, so many ahead at most. What fails there fails here; when the
    taker stops early, the thread ends."""
    ready, stopped = queue.Queue(maxsize=max(1, ahead)), threading.Event()

    def put(item: tuple) -> bool:
        while not stopped.is_set():
            try:
                ready.put(item, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def work() -> None:
        try:
            for row in rows:
                if not put((row, None)):
                    return
            put((None, StopIteration()))
        except BaseException as e:  # handed over to the taker
            put((None, e))

    threading.Thread(target=work, daemon=True).start()
    try:
        while True:
            row, end = ready.get()
            if isinstance(end, StopIteration):
                return
            if end is not None:
                raise end
            yield row
    finally:
        stopped.set()


def batches(rows: DataFrame, size: int = BATCH, seed: int | None = None, buffer: int = BUFFER, ahead: int = 2, make: Callable[[list], X] = list) -> Iterator[X]:
    """Batches of rows for a loop on the driver, partition by partition, made ready ahead by make(). With a
    seed they are shuffled by a buffer, else in the order of the rows; the last one may be smaller."""
    coming = rows.toLocalIterator(prefetchPartitions=True)
    coming = coming if seed is None else shuffled(coming, buffer, seed)
    return prefetched((make(list(b)) for b in batched(coming, size)), ahead)


def in_tasks(rows: DataFrame, work: Callable[[list[dict]], list[dict]], schema: str, size: int = BATCH, seed: int | None = None, buffer: int = BUFFER) -> DataFrame:
    """What work() makes of batches, where the partitions are: each is a loader of its own, with the seed
    and the partition's number as its seed."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in found for at in range(0, b.num_rows, 256) for row in b.slice(at, 256).to_pylist())
        if seed is not None:
            each = shuffled(each, buffer, seed * 1_000_003 + TaskContext.get().partitionId())
        for some in batched(each, size):
            yield pa.RecordBatch.from_pylist(work(list(some)), kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)
