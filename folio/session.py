"""Sessions, and sending the library to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str = "folio", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and small runs; on a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or for a local
    session without it the temp folder. On a cluster without it: an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = os.path.join(tempfile.gettempdir(), "folio-checkpoints")
    return f"{shared.rstrip('/')}/folio/{name}-{uuid.uuid4().hex}"


def ship_library(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_folio_shipped", False):
        return
    package = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="folio-"), "folio.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"folio/{f.relative_to(package)}")
    context.addPyFile(path)
    context._folio_shipped = True
