"""An extension: classify files as they arrive in a folder, and append the records to a table or the history."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions.text import file_name
from folio.operators.classify import classify
from folio.sources.files import IMAGE, MAX_UPLOAD
from folio.sources.history import History
from folio.sources.store import opened

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, threshold: float = 0.60) -> StreamingQuery:
    """Score vectors (pos, arquivo, p) arrive as Parquet files; records are appended to out. Handles
    all that is there and then ends; the checkpoint keeps what was done already."""
    # One time of analysis for all that a start of the query handles.
    scores: DataFrame = spark.readStream.schema("pos bigint, arquivo string, p array<double>").parquet(folder)
    return classify(scores, threshold).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def watch_images(spark: SparkSession, folder: str, history: History, checkpoint: str, engine: Callable[[DataFrame], DataFrame], files_at_once: int = 1000) -> StreamingQuery:
    """Images arrive as files; engine makes records of items (pos, arquivo, imagem), and the history takes
    them in. Handles all that is there and then ends; the checkpoint keeps what was done already.

    A batch's number stands in the history's commit, so a batch that is run again, because the driver was
    lost between the history's commit and the checkpoint's, adds nothing. pos is the place in the order
    of arrival, then of the path. Files over the size of an upload, and empty ones, are left out."""

    def keep(batch: DataFrame, number: int) -> None:
        fs, base = opened(checkpoint)
        with fs.open_input_stream(f"{base}/metadata") as f:
            source = json.loads(f.read())["id"]  # of the query, the same after every restart
        if history.state().has((source, number)):
            return
        order = F.struct("modificationTime", "path")
        # At most files_at_once rows without contents: their places are worked out in one task.
        names = batch.select("path", "modificationTime").persist()
        places = names.groupBy().agg(F.array_sort(F.collect_list(order)).alias("all")).select(F.posexplode("all").alias("pos", "f")).select(F.col("pos").cast("long").alias("pos"), "f.path")
        items = batch.join(places, "path").select("pos", file_name(F.col("path")).alias("arquivo"), F.col("content").alias("imagem"))
        history.save_all(engine(items), numbered=(source, number))
        names.unpersist()

    arriving = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_at_once).load(folder)
    images = arriving.filter(F.col("path").rlike(IMAGE) & F.col("length").between(1, MAX_UPLOAD))
    return images.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
