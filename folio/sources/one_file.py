"""One text file from the rows of a table, in their order, written by tasks in two phases.

First, every task writes its partition to a part of its own, and Spark's commit lists the parts of the
attempts that count. Then tasks copy the parts to their places in a file that has its full length
already (or, in a store whose files can't be written in places, one task passes them on in chunks),
and the file gets its name. No row passes through the driver, which knows parts and lengths only. What
an attempt that failed has written is removed with the folder of the parts; until the last step,
nothing is seen under the file's name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folio.sources.store import is_local, opened, removed

MANIFEST = "manifest.json"
#: Rows that are one piece of text at a time, and bytes copied at a time.
SLICE_ROWS, CHUNK = 4096, 8 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    length: int


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, between: str):
        self.path, self.between = path, between

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        number, name = context.partitionId(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, base = opened(self.path)
        fs.create_dir(base, recursive=True)
        between, length = self.between.encode(), 0
        try:
            with fs.open_output_stream(f"{base}/{name}") as out:
                for batch in iterator:
                    for at in range(0, batch.num_rows, SLICE_ROWS):
                        text = between.join(x.encode() for x in batch.column(0).slice(at, SLICE_ROWS).to_pylist())
                        text = between + text if length else text
                        out.write(text)
                        length += len(text)
        except BaseException:
            fs.delete_file(f"{base}/{name}")
            raise
        return Part(number, name, length)

    def commit(self, messages: list[Part | None]) -> None:
        fs, base = opened(self.path)
        fs.create_dir(base, recursive=True)
        parts = sorted((m.number, m.name, m.length) for m in messages if m is not None and m.length)
        with fs.open_output_stream(f"{base}/.{MANIFEST}") as out:
            out.write(json.dumps(parts).encode())
        fs.move(f"{base}/.{MANIFEST}", f"{base}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        removed(self.path)


class PartsSource(DataSource):
    """df.write.format("folio_parts"): the only column's texts, with the option `between` between them, a
    file for each partition."""

    @classmethod
    def name(cls) -> str:
        return "folio_parts"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        if len(schema.fields) != 1:
            raise ValueError("one column of text is written")
        return PartsWriter(self.options["path"], self.options.get("between", ""))


def write_one_file(lines: DataFrame, target: str, head: str = "", between: str = "", tail: str = "", in_places: bool | None = None) -> str:
    """Write head, the texts of the only column in the order of the rows with between in between, and tail
    to target; its path. A file of that name is replaced once the new one is whole.

    in_places: whether tasks write to their places in one file; None: where the file system is a
    mounted one. Null texts are an error."""
    spark = lines.sparkSession
    fs, path = opened(target)
    folder, _, name = path.rpartition("/")
    uri = target.rpartition("/")[0] or "."
    scratch = f"{uri}/.{name}.{uuid.uuid4().hex}"
    spark.dataSource.register(PartsSource)
    fs.create_dir(folder, recursive=True)
    fs.create_dir(opened(scratch)[1], recursive=True)
    try:
        lines.write.format("folio_parts").option("path", scratch).option("between", between).mode("append").save()
        with fs.open_input_stream(f"{opened(scratch)[1]}/{MANIFEST}") as f:
            parts = json.loads(f.read())
        place = _placed if (is_local(fs) if in_places is None else in_places) else _passed_on
        place(spark, scratch, parts, head.encode(), between.encode(), tail.encode())
        fs.move(f"{opened(scratch)[1]}/whole", path)
    finally:
        removed(scratch)
    return target


def _placed(spark: SparkSession, scratch: str, parts: list, head: bytes, between: bytes, tail: bytes) -> None:
    """The whole file from parts that tasks copy to their offsets. A copy that is made twice is the same."""
    _, base = opened(scratch)
    places, at = [], len(head)
    for k, (_, name, length) in enumerate(parts):
        at += len(between) if k else 0
        places.append((name, at, length))
        at += length
    with open(f"{base}/whole", "wb") as f:
        f.write(head)
        for _, start, _ in places[1:]:
            f.seek(start - len(between))
            f.write(between)
        f.seek(at)
        f.write(tail)
        f.truncate(at + len(tail))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open(f"{base}/{name}", "rb") as part, open(f"{base}/whole", "r+b") as whole:
                    whole.seek(start)
                    copied = 0
                    while chunk := part.read(CHUNK):
                        whole.write(chunk)
                        copied += len(chunk)
                if copied != length:
                    raise OSError(f"{name} has {copied} bytes, not {length}")
            yield pa.RecordBatch.from_arrays([b.column(2)], names=["copied"])

    if places:
        copies = spark.createDataFrame(places, "name string, start bigint, length bigint").repartition(min(len(places), 256))
        copied = sum(r.copied for r in copies.mapInArrow(copy, "copied bigint").groupBy().sum("copied").toDF("copied").collect())
        if copied != sum(p[2] for p in places):
            raise OSError(f"{copied} bytes of the parts were copied")


def _passed_on(spark: SparkSession, scratch: str, parts: list, head: bytes, between: bytes, tail: bytes) -> None:
    """The whole file from one task that passes the parts on in chunks: an upload in pieces, in stores
    that have it."""
    names = [name for _, name, _ in parts]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fs, base = opened(scratch)
            with fs.open_output_stream(f"{base}/whole") as out:
                out.write(head)
                for k, name in enumerate(names):
                    out.write(between if k else b"")
                    with fs.open_input_stream(f"{base}/{name}") as part:
                        while chunk := part.read(CHUNK):
                            out.write(chunk)
                out.write(tail)
            yield b

    spark.range(1).repartition(1).mapInArrow(copy, "id bigint").collect()


def parts_left(folder: str) -> list[str]:
    """Folders of parts that are there still: none, but while something is being written or after the
    driver was lost."""
    fs, base = opened(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("."))
