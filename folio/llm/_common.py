"""What several operators share: the shared folder, written tables, Arrow slices, caches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch that are Python objects at one time.
SLICE_ROWS = 256
#: Bytes of a batch of more than one row, at most.
SLICE_BYTES = 8 << 20
#: Entries of a per-worker memo before it starts afresh.
MEMO_ENTRIES = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names
    one. A local session without one gets a folder under the temp folder; on a cluster that is an
    error, since every machine would have a temp folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "folio-checkpoints"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths of this process that are not removed yet.
_FRESH: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"
    _FRESH.add(path)
    return path


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write the table to the shared folder as Parquet and read it again. Its path
    may be removed once nothing reads it any more."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _FRESH.discard(path)


def clear_written(spark: SparkSession) -> None:
    """Remove all tables and archives that operators of this process wrote to the shared folder: for
    long-lived sessions, once the results that read them are written elsewhere."""
    for path in sorted(_FRESH):
        removed(spark, path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of so many rows and bytes at most, but one row at least, so
    that few texts are Python strings at once."""
    for batch in batches:
        rest = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while rest:
            part = rest.pop()
            if part.num_rows > 1 and part.nbytes > most_bytes:
                rest += [part.slice(part.num_rows // 2), part.slice(0, part.num_rows // 2)]
            else:
                yield part


class Memo(dict):
    """A dict that works out what it misses, and starts afresh when it has grown too large."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self._make, self._entries = make, entries

    def __missing__(self, key):
        value = self._make(key)
        if len(self) >= self._entries:
            self.clear()
        self[key] = value
        return value


def scratch_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
