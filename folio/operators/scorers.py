"""Scoring engines behind one interface: items in, score vectors or answers out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.domain import check_class_order
from folio.functions.ranking import softmax
from folio.operators.evaluate import numbered
from folio.operators.merge import EngineUnavailable
from folio.sources import images
from folio.sources.files import IMAGE, image_files


def stub_scores(items: DataFrame, classes: int = 12, sharpness: float = 8.0) -> DataFrame:
    """items with p, a score vector made from the hash of the name: the same for the same name."""
    unit = [(F.pmod(F.xxhash64("arquivo", F.lit(i)), F.lit(1_000_003)) / 1_000_003.0 * sharpness) for i in range(classes)]
    return items.withColumn("p", softmax(F.array(*unit)))


def ask_remote(items: DataFrame, ask: Callable[[str], dict], in_flight: int = 3) -> DataFrame:
    """(pos, arquivo, resposta, erro): a remote engine's JSON answer for each item.

    Each task keeps so many calls in flight, so the cluster has that times the running tasks;
    repartition items to set how many. A call that fails gives erro instead of an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(name: str) -> tuple[str | None, str | None]:
            try:
                return json.dumps(ask(name), ensure_ascii=False), None
            except Exception as e:  # the engine's, of any kind
                return None, str(e).split("\n")[0]

        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                answers = list(pool.map(one, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a for a, _ in answers], pa.string()), pa.array([e for _, e in answers], pa.string())], names=["pos", "arquivo", "resposta", "erro"])

    return items.select(F.col("pos").cast("long"), "arquivo").mapInArrow(run, "pos bigint, arquivo string, resposta string, erro string")


def all_or_nothing(answers: DataFrame, partial_ok: bool = False) -> DataFrame:
    """The answers; one failed call makes the engine unavailable for the batch, unless partial_ok.
    Asks once: hand in answers that are written or cached."""
    if not partial_ok and (bad := answers.filter("erro IS NOT NULL").select("erro").first()):
        raise EngineUnavailable(bad[0])
    return answers.filter("erro IS NULL")


def onnx_scores(tensors: DataFrame, model_path: str, side: int = 224, batch: int = 32) -> DataFrame:
    """tensors with p in place of tensor, by an ONNX classifier of side x side x 3 float images.

    The session is made once for each Python worker, and anew when the file has changed; model_path
    is a path that all of them can open. Null tensors get a null p; a tensor of another size is a
    ValueError. Rows and all other columns stay."""
    import os

    stamp = os.path.getmtime(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = _session(model_path, stamp)
        name = session.get_inputs()[0].name
        for b in batches:
            tensors_, out = b.column(at_tensor).to_pylist(), [None] * b.num_rows
            filled = [i for i, t in enumerate(tensors_) if t is not None]
            if any(len(tensors_[i]) != 4 * 3 * side * side for i in filled):
                raise ValueError(f"tensors must be of {side} x {side} x 3 floats")
            for at in range(0, len(filled), batch):
                some = filled[at : at + batch]
                x = np.stack([np.frombuffer(tensors_[i], np.float32).reshape(side, side, 3) for i in some])
                for i, row in zip(some, session.run(None, {name: x})[0], strict=True):
                    out[i] = row.astype(float).tolist()
            kept = [c for i, c in enumerate(b.columns) if i != at_tensor]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.float64()))], names=[*(n for n in b.schema.names if n != "tensor"), "p"])

    at_tensor = tensors.columns.index("tensor")
    schema = T.StructType([*(f for f in tensors.schema if f.name != "tensor"), T.StructField("p", T.ArrayType(T.DoubleType()))])
    return tensors.mapInArrow(run, schema)


def folder_scores(spark: SparkSession, folder: str, model_path: str, side: int = 224) -> tuple[DataFrame, DataFrame]:
    """(scores, undecodable) of the images right in a folder: (pos, arquivo, p) in the order of their
    paths, and (arquivo) of those that could not be decoded, which have no place in that order."""
    listing = image_files(spark, folder, content=False)  # an error if there is none
    tensors = images.model_inputs(images.decoded(spark, folder), side).filter(F.col("path").rlike(IMAGE))
    scored = onnx_scores(tensors, model_path, side)
    bad = tensors.filter("tensor IS NULL").select("arquivo")
    placed = numbered(listing.select(F.regexp_replace("path", "^file:/+", "/").alias("path")), ["path"], "pos")
    return placed.join(scored.filter("p IS NOT NULL"), "path").select("pos", "arquivo", "p"), bad


@lru_cache(maxsize=1)
def _session(model_path: str, stamp: float):
    import onnxruntime

    return onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])


def read_model_metadata(spark: SparkSession, path: str) -> dict:
    """A model's metadata file, with versao ("architecture vX"); its classes must be the catalogue's."""
    schema = "versao_catalogo string, arquitetura string, tamanho_entrada array<int>, treinado_em string, acuracia_teste double, ids array<string>"
    row = spark.read.schema(schema).option("multiLine", True).json(path).first().asDict()
    check_class_order(row["ids"])
    return row | {"versao": f"{row['arquitetura'] or 'desconhecida'} v{row['versao_catalogo'] or '?'}"}
