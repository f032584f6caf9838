"""A tree of files as a table, hidden names included.

Spark's own listing leaves out what begins with a dot or an underscore. This source lists everything:
the upper levels are walked when the query is planned, until there are enough subtrees for the tasks,
and each subtree is then walked by one of them. Filters on the path's start, the name and the suffix
are pushed down: subtrees that they rule out are never entered.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringEndsWith, StringStartsWith

from folio.sources.store import is_local, opened

SCHEMA = "caminho string, nome string, sufixo string, length bigint, modificado timestamp"
#: Subtrees to be found before tasks take over, and levels that are walked for that at most.
SUBTREES, LEVELS = 64, 6
BATCH_ROWS = 8192


@dataclass
class Subtree(InputPartition):
    """Folders relative to the root; all below them, or only the files right in them."""

    folders: tuple[str, ...]
    deep: bool


def suffix_of(name: str) -> str:
    """In lower case, with its dot; none for names that only begin with one."""
    stem, dot, ending = name.rpartition(".")
    return f".{ending}".lower() if dot and stem.strip(".") else ""


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """(name, is it a folder, length, modified) of what is right in a folder. Links to folders are not
    followed; what is gone by the time it is looked at is left out."""
    if is_local(fs):
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        yield e.name, True, 0, 0.0
                    elif e.is_file():
                        at = e.stat()
                        yield e.name, False, at.st_size, at.st_mtime
                except FileNotFoundError:
                    continue
    else:
        for f in fs.get_file_info(pafs.FileSelector(folder)):
            when = f.mtime.timestamp() if f.mtime else 0.0
            yield f.base_name, f.type == pafs.FileType.Directory, f.size or 0, when


class TreeReader(DataSourceReader):
    def __init__(self, path: str, pruned: set[str]):
        self.path, self.pruned = path, pruned
        self.starts: list[str] = []
        self.not_starts: list[str] = []
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case StringStartsWith(("caminho",), value):
                    self.starts.append(value)
                case Not(StringStartsWith(("caminho",), value)):
                    self.not_starts.append(value)
                case StringEndsWith((("caminho" | "nome" | "sufixo") as column,), value):
                    self.tests.append((column, "ends", (value,)))
                case EqualTo((("nome" | "sufixo") as column,), value):
                    self.tests.append((column, "in", (value,)))
                case In((("nome" | "sufixo") as column,), values):
                    self.tests.append((column, "in", tuple(values)))
                case _:
                    yield f

    def enters(self, folder: str) -> bool:
        """Whether anything below a folder may be wanted."""
        inside = f"{folder}/"
        if folder.rpartition("/")[2] in self.pruned or any(inside.startswith(s) for s in self.not_starts):
            return False
        return all(inside.startswith(s) or s.startswith(inside) for s in self.starts)

    def wants(self, path: str, name: str) -> bool:
        if not all(map(path.startswith, self.starts)) or any(map(path.startswith, self.not_starts)):
            return False
        of = {"caminho": path, "nome": name, "sufixo": suffix_of(name)}
        return all(of[column].endswith(values[0]) if kind == "ends" else of[column] in values for column, kind, values in self.tests)

    def _folders(self, fs: pafs.FileSystem, base: str, folder: str) -> list[str]:
        found = (f"{folder}/{name}" if folder else name for name, is_folder, _, _ in _entries(fs, f"{base}/{folder}" if folder else base) if is_folder)
        return sorted(filter(self.enters, found))

    def partitions(self) -> list[Subtree]:
        fs, base = opened(self.path)
        walked, level = [""], self._folders(fs, base, "")
        for _ in range(LEVELS):
            if not level or len(level) >= SUBTREES:
                break
            walked, level = walked + level, [f for folder in level for f in self._folders(fs, base, folder)]
        return [Subtree(tuple(walked), False), *(Subtree((f,), True) for f in level)]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        fs, base = opened(self.path)
        rest, rows = list(partition.folders)[::-1], []
        while rest:
            folder = rest.pop()
            for name, is_folder, length, when in _entries(fs, f"{base}/{folder}" if folder else base):
                path = f"{folder}/{name}" if folder else name
                if is_folder:
                    if partition.deep and self.enters(path):
                        rest.append(path)
                elif self.wants(path, name):
                    rows.append((path, name, suffix_of(name), length, datetime.datetime.fromtimestamp(when, datetime.UTC)))
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["caminho", "nome", "sufixo", "length", "modificado"])


class TreeSource(DataSource):
    """spark.read.format("folio_tree").load(folder): (caminho, nome, sufixo, length, modificado) of every
    file below a folder, paths relative to it. Option without: a JSON list of names of folders that are
    not entered at any depth."""

    @classmethod
    def name(cls) -> str:
        return "folio_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], set(json.loads(self.options.get("without", "[]"))))


def file_tree(spark: SparkSession, folder: str, without: list[str] | None = None) -> DataFrame:
    """TreeSource as a DataFrame; a folder that isn't there is an error."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("folio_tree").option("without", json.dumps(without or [])).load(folder)


def planted(rows: DataFrame, folder: str, content: Callable[[dict], bytes] = lambda r: b"x" * r["length"]) -> int:
    """Write a file for each row(caminho, length) below a folder, by tasks; how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        for b in batches:
            for r in b.to_pylist():
                target = f"{base}/{r['caminho']}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(target) as out:
                    out.write(content(r))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    return rows.mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0
