"""One object for applications: analyse batches, keep their history, export it."""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folio import domain as D
from folio.operators import merge
from folio.sources import exports, files, images
from folio.sources.history import History
from folio.sources.store import removed


@contextlib.contextmanager
def reported(spark: SparkSession, progress: Callable[[int, int], None] | None, every: float = 0.5) -> Iterator[None]:
    """Tell progress(done, known) about the tasks of the jobs that this thread runs meanwhile, when it changes."""
    if progress is None:
        yield
        return
    context, group, over, seen = spark.sparkContext, uuid.uuid4().hex, threading.Event(), {}

    def tell() -> None:
        tracker, last = context.statusTracker(), None
        while True:
            ended = over.wait(every)
            for job in tracker.getJobIdsForGroup(group):
                info = tracker.getJobInfo(job)
                for stage in info.stageIds if info else ():
                    if at := tracker.getStageInfo(stage):
                        seen[stage] = (at.numCompletedTasks, at.numTasks)
            now = tuple(map(sum, zip(*seen.values(), strict=True))) if seen else (0, 0)
            if now != last:
                progress(*now)
                last = now
            if ended:
                return

    context.setJobGroup(group, "analysis")
    teller = threading.Thread(target=tell, daemon=True)
    teller.start()
    try:
        yield
    finally:
        over.set()
        teller.join()
        context.setLocalProperty("spark.jobGroup.id", None)


class Engine:
    """cnn and vlm take items (pos, arquivo, ...) and return records, or raise EngineUnavailable."""

    def __init__(self, spark: SparkSession, history_path: str, cnn: Callable[[DataFrame], DataFrame], vlm: Callable[[DataFrame], DataFrame]):
        self.spark, self.history, self.cnn, self.vlm = spark, History(spark, history_path), cnn, vlm
        self._id, self._scratch = uuid.uuid4().hex, []

    def state(self) -> dict:
        """Modes, threshold, classes and the number of records kept."""
        return {"modos": list(dict.fromkeys(merge.MODES.values())), "limiar_padrao": D.THRESHOLD, "classes": [{"id": c[0], "cultura": c[2], "diagnostico": c[3], "condicao": c[4]} for c in D.CATALOGUE], "total_historico": self.history.total()}

    def analyse(self, items: DataFrame, mode: str = merge.AUTO, keep: bool = True, progress: Callable[[int, int], None] | None = None) -> tuple[DataFrame, list[str]]:
        """(records, warnings). What an engine answers is written once and read from there by all that
        follows: no item is asked about twice, and history and caller have the same answers. Items
        without a record are left out; a warning says how many, counted as the records are written.

        With keep, records come back from the history, each with its id_historico; a column miniatura
        of the items is kept as their picture, once for all records that show it. Without, what was
        answered stays in the folder of answers until close(). progress is told from time to time how
        many tasks are done, and of how many that are known so far."""
        with reported(self.spark, progress):
            dropped = Observation()
            merged, warnings = merge.analyse(items, lambda i: self._once(self.cnn(i)), lambda i: self._once(self.vlm(i)), mode, dropped)
            records = self._once(merged)
            if n := dropped.get.get("descartados", 0) if items.head(1) else 0:
                warnings.append(f"{n} items have no record and were left out")
            if keep:
                pictures = items.select("pos", "miniatura") if "miniatura" in items.columns else None
                records, _ = self.history.save_all(records, pictures)
                self.close()
        return records, warnings

    def analyse_uploads(self, contents: dict[str, bytes], mode: str = merge.AUTO, keep: bool = True) -> tuple[DataFrame, list[str]]:
        """As analyse(), of files in memory by their names. The engines get items (pos, arquivo, imagem,
        miniatura, and what images.decoded() has); what can't be read is left out with a warning, and
        ValueError if nothing is left."""
        good, bad = files.set_aside(files.uploads(self.spark, contents))
        warnings = [f"{r.arquivo}: {r.motivo}" for r in bad.select("pos", "arquivo", "motivo").orderBy("pos").collect()]
        decoded, folder = images.decoded_bytes(good)
        self._scratch.append(folder)
        broken = decoded.filter("altura <= 0").select("pos", "arquivo").orderBy("pos").collect()
        warnings += [f"{r.arquivo}: não foi possível ler" for r in broken]
        if len(warnings) == len(contents):
            raise ValueError("; ".join(warnings) or "no files")
        decoded = decoded.filter("altura > 0")
        items = decoded.join(images.requests(decoded).select("path", "imagem"), "path").join(images.thumbnails(decoded).select("path", "miniatura"), "path")
        records, more = self.analyse(items, mode, keep)
        return records, warnings + more

    @property
    def _answers(self) -> str:
        return f"{self.history.path}-answers/{self._id}"

    def _once(self, answers: DataFrame) -> DataFrame:
        path = f"{self._answers}/{uuid.uuid4().hex}"
        answers.write.parquet(path)
        return self.spark.read.schema(answers.schema).parquet(path)

    def close(self) -> None:
        """Remove the answers of batches that were not kept: their records can't be read any more."""
        removed(self._answers)
        while self._scratch:
            removed(self._scratch.pop())

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def export(self, folder: str, prefix: str = "historico", formats: tuple[str, ...] = exports.FORMATS) -> list[Path]:
        """The whole history as files of these formats; an error if there is none, or for an unknown
        format."""
        if not self.history.total():
            raise LookupError("the history is empty")
        return exports.save(self.history.records(), folder, prefix, formats=formats)


def serialised(records: DataFrame) -> DataFrame:
    """(pos, documento): each record as JSON, its ranking as label and confidence; nulls are kept.
    id_historico is the record's id in the history, null if records have none."""
    labels = F.create_map(*[x for c in D.CATALOGUE for x in (F.lit(c[0]), F.lit(f"{c[2]} — {c[3]}"))])
    shown = F.transform("ranking", lambda r: F.struct(F.element_at(labels, r["id_classe"]).alias("rotulo"), r["confianca"].alias("confianca")))
    fields = [c for c in D.RECORD.names if c != "ranking"]
    kept_as = (F.col("id_historico") if "id_historico" in records.columns else F.lit(None)).cast("bigint").alias("id_historico")
    return records.select("pos", F.to_json(F.struct(kept_as, *fields, shown.alias("ranking")), {"ignoreNullFields": "false"}).alias("documento"))


def save_metrics(measures: dict, path: str) -> None:
    """Model measures as indented JSON."""
    Path(path).write_text(json.dumps(measures, ensure_ascii=False, indent=2), encoding="utf-8")
