"""Files by path or URI, opened in the driver and in tasks alike."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI that Arrow knows (file, hdfs, s3, gs)."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), os.path.abspath("/" + path[5:].lstrip("/"))
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def is_local(fs: pafs.FileSystem) -> bool:
    return isinstance(fs, pafs.LocalFileSystem)


def removed(path: str) -> None:
    """Remove a folder or file and all in it; nothing happens if it isn't there."""
    fs, inner = opened(path)
    kind = fs.get_file_info(inner).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(inner)
    elif kind == pafs.FileType.File:
        fs.delete_file(inner)


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file as a whole, unless there is one of that name: then FileExistsError. Mounted file
    systems link it in place; others must have a rename that fails where a file is, as HDFS has."""
    fs, inner = opened(path)
    folder, _, name = inner.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if is_local(fs):
        with open(draft, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, inner)
        finally:
            os.unlink(draft)
        return
    with fs.open_output_stream(draft) as out:
        out.write(content)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at = lambda p: jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0] + "/" + p.rpartition("/")[2])
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(draft).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(at(draft), at(inner), none)
    except Exception as e:
        fs.delete_file(draft)
        if "FileAlreadyExists" in str(e):
            raise FileExistsError(path) from e
        raise
