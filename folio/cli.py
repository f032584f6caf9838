"""Diagnose a folder of images with an ONNX classifier and a remote engine: spark-submit folio/cli.py FOLDER
--modelo M.onnx --vlm package.module:function --respostas ANSWERS --motor auto --saida OUT. The remote
engine is a function that takes a Request and returns an answer. Without a model the folder is a table of
ready score vectors, or images if only the remote engine is asked."""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from folio import domain as D
from folio.functions import text
from folio.operators import merge, remote, scorers
from folio.operators.classify import classify
from folio.operators.evaluate import numbered
from folio.session import ship_library
from folio.sources import exports, files, images


def _no_vlm(_):
    raise merge.EngineUnavailable("no remote engine is set up")


def _vlm(spark: SparkSession, args: argparse.Namespace):
    """The remote engine of the command line: items get their pictures by name from the folder."""
    module, _, name = args.vlm.partition(":")
    ask = getattr(importlib.import_module(module), name)
    store = remote.AnswerStore(spark, args.respostas)
    engine = remote.RemoteEngine(store, ask, args.vlm_versao, args.instrucoes, per_minute=args.por_minuto, partial_ok=args.parcial)

    def run(items):
        if args.modelo or args.motor == "vlm":
            pictures = images.requests(images.decoded(spark, args.pasta))
            items = items.join(pictures.select("arquivo", "imagem"), "arquivo", "left")
        return engine(items)

    return run


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("pasta", help="folder of images; without --modelo, Parquet with pos, arquivo, p")
    parser.add_argument("--modelo", help="ONNX file of a classifier whose classes are the catalogue's, in its order")
    parser.add_argument("--lado", type=int, default=224, help="side of the model's input")
    parser.add_argument("--motor", choices=sorted(merge.MODES), default="auto")
    parser.add_argument("--vlm", help="the remote engine, as module:function")
    parser.add_argument("--vlm-versao", default="remote", help="its version: answers of another one don't count")
    parser.add_argument("--instrucoes", default="", help="what it is told beside the image")
    parser.add_argument("--respostas", default="respostas", help="folder in which its answers are kept")
    parser.add_argument("--por-minuto", type=float, help="calls a minute, at most")
    parser.add_argument("--parcial", action="store_true", help="leave out images that it has no answer to")
    parser.add_argument("--saida", default="exportacoes")
    parser.add_argument("--limiar", type=float, default=D.THRESHOLD)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship_library(spark)
    try:
        warnings = []
        if args.modelo:
            items, bad = scorers.folder_scores(spark, args.pasta, args.modelo, args.lado)
            warnings = [f"{r.arquivo} could not be decoded" for r in bad.orderBy("arquivo").limit(20).collect()]
        elif args.motor == "vlm" and args.vlm:
            items = numbered(files.image_files(spark, args.pasta, content=False), ["path"], "pos").select("pos", "arquivo")
        else:
            items = spark.read.parquet(args.pasta)
        as_of, version = text.now_iso(), Path(args.modelo).stem if args.modelo else "stub v1.0.0"
        items = items.cache()
        records, more = merge.analyse(items, lambda i: classify(i, args.limiar, as_of, version), _vlm(spark, args) if args.vlm else _no_vlm, merge.MODES[args.motor])
        records = records.cache()
        for r in records.orderBy("pos", "ordem").select(text.padded(records["arquivo"], 32).alias("a"), text.padded(records["diagnostico"], 28).alias("d"), "motor", "confianca_texto").toLocalIterator():
            print(f"  [{'CNN' if r.motor == D.CNN else 'VLM'}] {r.a} {r.d} {r.confianca_texto}")
        paths = exports.save(records, args.saida, prefix=Path(args.pasta).name if args.modelo else "analise", threshold=args.limiar, order=("pos", "ordem"))
        totals = merge.summary(records).first().asDict()
        records.unpersist()
        items.unpersist()
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    for w in warnings + more:
        print(f"warning: {w}", file=sys.stderr)
    print(totals)
    print(*paths, sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
