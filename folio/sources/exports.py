"""Export rows, and CSV and JSON files of them."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio import domain as D
from folio.functions import text
from folio.sources.one_file import write_one_file


def _alternative(place: int) -> tuple[Column, Column]:
    """Label and confidence of a place in the ranking (from 1); "—" and null where it has none."""
    entry = F.try_element_at("ranking", F.lit(place))
    pairs = []
    for id_, _, culture, diagnosis, *_ in D.CATALOGUE:
        pairs += [F.lit(id_), F.lit(f"{culture} — {diagnosis}")]
    labels = F.create_map(*pairs)
    return F.coalesce(F.element_at(labels, entry["id_classe"]), F.lit(D.MISSING)), text.rounded(entry["confianca"], 4)


def export_rows(records: DataFrame) -> DataFrame:
    """The 17 export columns in their order; numbers stay numbers, missing ones null."""
    (label_1, conf_1), (label_2, conf_2) = _alternative(2), _alternative(3)
    renamed = {"agente_causal": F.col("agente"), "sintomas_observados": F.col("sintomas"), "manejo_recomendado": F.col("manejo"), "confianca": text.rounded(F.col("confianca"), 4), "alternativa_1": label_1, "confianca_alternativa_1": conf_1, "alternativa_2": label_2, "confianca_alternativa_2": conf_2}
    return records.select(*[renamed.get(c, F.col(c)).alias(c) for c in D.EXPORT_COLUMNS])


def metadata(records: DataFrame, threshold: float = D.THRESHOLD, as_of: str | None = None) -> dict:
    """Totals and counts for the JSON document; threshold is the one that was used."""
    counts = [F.count_if(F.col("condicao") == c) for c in D.CONDITIONS]
    engines = [F.count_if(F.col("motor") == m) for m in (D.CNN, D.VLM)]
    total, files, *rest = records.agg(F.count("*"), F.countDistinct("arquivo"), *engines, *counts).first()
    return {
        "gerado_em": as_of or datetime.datetime.now().isoformat(timespec="seconds"),
        "limiar_confianca_cnn": threshold,
        "total_laudos": total,
        "total_imagens": files,
        "laudos_por_motor": dict(zip([D.CNN, D.VLM], rest[:2], strict=True)),
        "contagem_por_condicao": dict(zip(D.CONDITIONS, rest[2:], strict=True)),
    }


def csv_text(rows: DataFrame) -> DataFrame:
    """Export rows with numbers as text with a decimal comma, in any mix of engines."""
    numbers = {f.name for f in rows.schema if f.dataType.simpleString() == "double"}
    return rows.select(*[text.decimal_comma(F.col(c)).alias(c) if c in numbers else F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns])


def _lines(rows: DataFrame) -> DataFrame:
    quoted = lambda c: F.when(F.col(c).rlike('[;"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return rows.select(F.concat(F.concat_ws(";", *[quoted(c) for c in rows.columns]), F.lit("\n")).alias("line"))


#: What save() can write.
FORMATS = ("csv", "json")


def save(records: DataFrame, folder: str, prefix: str = "analise", threshold: float = D.THRESHOLD, now: datetime.datetime | None = None, order: tuple[str, ...] = ("pos",), formats: tuple[str, ...] = FORMATS) -> list[Path]:
    """Write {prefix}_{stamp}.csv (semicolons, BOM) and .json, or those of them that are asked for; their
    paths. An unknown format is an error.

    One file of each kind is what is asked for; tasks write it, see write_one_file(). The folder is a
    path or URI that driver and executors share; paths of URIs are texts."""
    if unknown := set(formats) - set(FORMATS):
        raise ValueError(f"unknown format {sorted(unknown)[0]!r}")
    stamp = (now or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")
    rows = export_rows(records.orderBy(*order))
    paths = []
    for kind in FORMATS:
        if kind in formats:
            target = f"{str(folder).rstrip('/')}/{prefix}_{stamp}.{kind}"
            if kind == "csv":
                write_one_file(_lines(csv_text(rows)), target, head="\ufeff" + ";".join(D.EXPORT_COLUMNS) + "\n")
            else:
                _write_json(rows, records, threshold, target)
            paths.append(target if "://" in target else Path(target))
    return paths


def _write_json(rows: DataFrame, records: DataFrame, threshold: float, target: str) -> None:
    totals = json.dumps(metadata(records, threshold), ensure_ascii=False, indent=2).replace("\n", "\n  ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = ({k: "" if v is None else v for k, v in r.items()} for r in b.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(["\n    " + json.dumps(c, ensure_ascii=False) for c in cells], pa.string())], names=["line"])

    write_one_file(rows.mapInArrow(run, "line string"), target, head='{\n  "metadata": ' + totals + ',\n  "resultados": [', between=",", tail="\n  ]\n}\n")
