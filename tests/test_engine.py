"""The engine object, the command line and model metadata."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from folio import cli, domain as D
from folio.engine import Engine, serialised
from folio.operators import merge, scorers
from folio.operators.classify import answers_to_records, classify, parse_answers, with_class
from folio.operators.labels import check_label_map, kept_labels
from folio.plans.fixtures import LABEL_NAMES

ITEMS = "pos bigint, arquivo string, p array<double>"


def no_vlm(_):
    raise merge.EngineUnavailable("no key")


def items(spark):
    return spark.createDataFrame([(0, "a", [0.9] + [0.1 / 11] * 11), (1, "b", [1 / 12] * 12)], ITEMS)


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "h"), classify, no_vlm)
    with pytest.raises(LookupError):
        e.export(str(tmp_path))
    records, warnings = e.analyse(items(spark))
    assert records.count() == 2 and len(warnings) == 1
    assert e.state()["total_historico"] == 2 and len(e.state()["classes"]) == 12
    csv, doc = e.export(str(tmp_path))
    assert len(csv.read_text(encoding="utf-8-sig").splitlines()) == 3
    assert all(r["alternativa_1"] == "—" for r in json.loads(doc.read_text(encoding="utf-8"))["resultados"])
    shown = json.loads(serialised(records).filter("pos = 0").first().documento)
    assert shown["ranking"][0]["rotulo"] == "Maçã — Saudável" and "confianca" in shown


def test_each_item_is_asked_about_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def remote(d):
        def ask(name):
            calls.add(1)
            return {"e_planta": True, "especie": name, "parte_analisada": "folha", "condicao": D.HEALTHY, "diagnostico": str(calls), "agente_causal": "—", "sintomas_observados": "", "manejo_recomendado": "", "confianca": "alta", "observacoes": ""}

        return answers_to_records(parse_answers(scorers.all_or_nothing(scorers.ask_remote(d, ask), partial_ok=True)).filter("valido"))

    e = Engine(spark, str(tmp_path / "h"), classify, remote)
    records, _ = e.analyse(items(spark), merge.ONLY_VLM)
    assert records.count() == 2 and {r.arquivo for r in records.collect()} == {"a", "b"}
    assert e.history.rows.count() == 2 and calls.value == 2
    assert all(abs(datetime.datetime.now() - datetime.datetime.fromisoformat(r.data_hora)) < datetime.timedelta(minutes=10) for r in records.collect())
    with pytest.raises(ValueError):
        e.export(str(tmp_path), formats=("xlsx",))
    (only,) = e.export(str(tmp_path), formats=("json",))
    assert only.suffix == ".json"
    kept = e.history.records().withColumn("id_historico", F.col("id"))
    assert {json.loads(r.documento)["id_historico"] for r in serialised(kept).collect()} == {r.id for r in e.history.rows.collect()}


def test_classes_outside_the_catalogue_are_errors(spark):
    for p in ([1 / 13] * 13, [], None):
        with pytest.raises(Exception, match="12 values"):
            classify(spark.createDataFrame([(0, "a", p)], ITEMS)).collect()
    d = spark.createDataFrame([("apple_scab",), ("rose",)], "id_classe string")
    assert with_class(d.limit(1)).first().info.cultura == "Maçã"
    with pytest.raises(Exception, match="unknown class: rose"):
        with_class(d).collect()


def test_label_map(spark):
    names = spark.createDataFrame([(n,) for n in LABEL_NAMES[:8]], "n string")
    with pytest.raises(ValueError, match="of 12"):
        check_label_map(names, "n")
    all_of_them = spark.createDataFrame([(" ".join(c[1]),) for c in D.CATALOGUE] + [("rose",)], "n string")
    check_label_map(all_of_them, "n")
    with pytest.raises(ValueError, match="several"):
        check_label_map(all_of_them.union(spark.createDataFrame([("apple SCAB 2",)], "n string")), "n")
    assert kept_labels(all_of_them, "n").count() == 12


def test_cli(spark, tmp_path, capsys):
    items(spark).write.parquet(str(tmp_path / "s"))
    assert cli.main([str(tmp_path / "s"), "--motor", "cnn", "--saida", str(tmp_path / "o")]) == 0
    assert "'total_laudos': 2" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none"), "--saida", str(tmp_path / "o")]) == 1


def test_metadata(spark, tmp_path):
    ids = [c[0] for c in D.CATALOGUE]
    meta = {"versao_catalogo": "1.0.0", "arquitetura": None, "tamanho_entrada": [224, 224], "ids": ids}
    (tmp_path / "m.json").write_text(json.dumps(meta, indent=1))
    assert scorers.read_model_metadata(spark, str(tmp_path / "m.json"))["versao"] == "desconhecida v1.0.0"
    (tmp_path / "m.json").write_text(json.dumps(meta | {"ids": ids[::-1]}))
    with pytest.raises(ValueError):
        scorers.read_model_metadata(spark, str(tmp_path / "m.json"))


def test_same_name_same_stub_scores(spark):
    d = scorers.stub_scores(items(spark).drop("p").union(items(spark).drop("p")))
    assert d.groupBy("arquivo").agg(F.countDistinct(F.col("p").cast("string")).alias("n")).filter("n > 1").count() == 0
