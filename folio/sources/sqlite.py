"""The history as an SQLite file: read in ranges of row ids by several tasks, filters pushed down."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from folio.sources.history import COLUMNS

SCHEMA = "id bigint, " + ", ".join(f"{c} {'double' if c == 'confianca' else 'binary' if c == 'miniatura' else 'string'}" for c in COLUMNS)
NAMES = ["id", *COLUMNS]
#: Rows of a batch, and of a range of ids unless there are more of them than partitions.
BATCH_ROWS, LEAST_RANGE = 1024, 1000
_ORDERED = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class IdRange(InputPartition):
    first: int
    last: int


class HistoryReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], partitions: int):
        self.path, self.columns, self.most = path, columns, partitions
        self.where: list[str] = []
        self.values: list = []

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if column not in NAMES or column == "miniatura":
                yield f
            elif isinstance(f, EqualTo):
                self._push(f"{column} = ?", f.value)
            elif isinstance(f, In):
                self._push(f"{column} IN ({', '.join('?' * len(f.value))})", *f.value)
            elif type(f) in _ORDERED and column in ("id", "confianca"):  # texts may be ordered otherwise there
                self._push(f"{column} {_ORDERED[type(f)]} ?", f.value)
            else:
                yield f

    def _push(self, condition: str, *values) -> None:
        self.where.append(condition)
        self.values.extend(values)

    def partitions(self) -> list[IdRange]:
        """Ranges of equal width; ids are the table's row ids, so that each is looked up, not searched."""
        with self._open() as db:
            condition = " AND ".join(["1", *(w for w in self.where if w.startswith("id "))])
            values = [v for w, v in zip(self.where, self.values, strict=False) if w.startswith("id ")] if all("?" == w[-1] for w in self.where) else None
            first, last = db.execute(f"SELECT min(id), max(id) FROM laudos WHERE {condition if values is not None else '1'}", values or []).fetchone()
        if first is None:
            return [IdRange(1, 0)]
        width = max(LEAST_RANGE, -(-(last - first + 1) // self.most))
        return [IdRange(a, min(last, a + width - 1)) for a in range(first, last + 1, width)]

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        kinds = {"id": pa.int64(), "confianca": pa.float64(), "miniatura": pa.binary()}
        condition = " AND ".join(["id BETWEEN ? AND ?", *self.where])
        with self._open() as db:
            found = db.execute(f"SELECT {', '.join(self.columns)} FROM laudos WHERE {condition} ORDER BY id", [partition.first, partition.last, *self.values])
            while rows := found.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for c, n in zip(zip(*rows, strict=True), self.columns, strict=True)], names=self.columns)


class HistorySource(DataSource):
    """spark.read.format("folio_sqlite").load(file): the table laudos. Option partitions: how many ranges
    of ids at most. The file must be one that all tasks can open; it is opened for reading only."""

    @classmethod
    def name(cls) -> str:
        return "folio_sqlite"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options["path"], [f.name for f in schema.fields], int(self.options.get("partitions", "64")))


def sqlite_history(spark: SparkSession, path: str, partitions: int = 64) -> DataFrame:
    """(id, the record's columns) of a history kept in an SQLite file."""
    spark.dataSource.register(HistorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("folio_sqlite").option("partitions", partitions).load(path.removeprefix("file://"))
