"""Traps of the record semantics, on small hand-made inputs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from folio import domain as D
from folio.functions import ranking, text
from folio.operators import classify, evaluate, labels, merge, scorers
from folio.sources import exports, files
from folio.sources.history import History


def test_batches_are_shuffled_by_seed(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    order = lambda seed: [r.k for r in evaluate.batches(d, ["k"], 8, seed).orderBy("lote", "lugar").collect()]
    assert order(None) == list(range(100)) and order(1) == order(1) != order(2) != order(None)
    assert sorted(order(1)) == list(range(100)) and evaluate.batches(d, ["k"], 8, 1).filter("lote = 12").count() == 4


def vector(first, at=0):
    p = [(1 - first) / 11] * 12
    p[at] = first
    return p


def scores(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, arquivo string, p array<double>")


def test_threshold_is_strict(spark):
    s = scores(spark, [(0, "a", vector(0.6, 1)), (1, "b", vector(0.5999, 1))])
    got = {r.arquivo: r.condicao for r in classify.classify(s).collect()}
    assert got == {"a": D.DISEASED, "b": D.UNDETERMINED}


def test_ties_go_to_the_last_index_in_rankings_and_the_first_in_argmax(spark):
    d = scores(spark, [(0, "a", [1 / 12] * 12)])
    r = d.select(ranking.top_k(F.col("p")).alias("t"), ranking.argmax(F.col("p")).alias("m")).first()
    assert [x.idx for x in r.t] == [11, 10, 9] and r.m == 0


def test_repeated_names_all_get_the_last_record(spark):
    s = scores(spark, [(0, "a", vector(0.9, 1)), (1, "a", vector(0.9, 3)), (2, "b", vector(0.9, 5))])
    cnn = classify.classify(s)
    got = merge.merge(s, cnn, cnn.limit(0), merge.ONLY_CNN).orderBy("pos").collect()
    assert [r.diagnostico for r in got] == ["Ferrugem comum", "Ferrugem comum", "Podridão-negra"]


def test_auto_asks_only_about_undetermined_and_takes_any_answer(spark):
    s = scores(spark, [(0, "a", vector(0.9, 1)), (1, "b", vector(0.2, 3))])
    asked = []

    def vlm(items):
        asked.extend(r.arquivo for r in items.collect())
        return classify.classify(s.filter("arquivo = 'b'")).withColumn("motor", F.lit(D.VLM))

    got, warnings = merge.analyse(s, classify.classify, vlm)
    assert asked == ["b"] and warnings == []
    assert [(r.arquivo, r.motor, r.condicao) for r in got.orderBy("pos").collect()] == [("a", D.CNN, D.DISEASED), ("b", D.VLM, D.UNDETERMINED)]


def unavailable(_):
    raise merge.EngineUnavailable("no key")


@pytest.mark.parametrize("mode", merge.MODES.values())
@pytest.mark.parametrize("cnn_out", [False, True])
@pytest.mark.parametrize("vlm_out", [False, True])
def test_failures(spark, mode, cnn_out, vlm_out):
    s = scores(spark, [(0, "a", vector(0.2, 1))])
    cnn = unavailable if cnn_out else classify.classify
    vlm = unavailable if vlm_out else lambda i: classify.classify(s).withColumn("motor", F.lit(D.VLM))
    uses_cnn, uses_vlm = mode != merge.ONLY_VLM, mode != merge.ONLY_CNN
    fatal = (cnn_out and mode == merge.ONLY_CNN) or (uses_vlm and vlm_out and (cnn_out or not uses_cnn))
    if fatal:
        with pytest.raises(merge.EngineUnavailable):
            merge.analyse(s, cnn, vlm, mode)
    else:
        got, warnings = merge.analyse(s, cnn, vlm, mode)
        assert len(warnings) == (uses_cnn and cnn_out) + (uses_vlm and vlm_out)
        assert got.count() == (2 if mode == merge.COMPARE and not warnings else 1)


def test_empty_batch_and_unknown_mode(spark):
    none = scores(spark, [])
    got, warnings = merge.analyse(none, unavailable, unavailable)
    assert got.count() == 0 and warnings == []
    with pytest.raises(ValueError):
        merge.analyse(none, unavailable, unavailable, "?")


def test_class_order_is_checked():
    ids = [c[0] for c in D.CATALOGUE]
    D.check_class_order(ids)
    with pytest.raises(ValueError):
        D.check_class_order(ids[::-1])


def test_ambiguous_labels(spark):
    names = spark.createDataFrame([("Apple corn healthy",), (None,), ("Tomato___Late_blight",)], "nome string")
    got = {r.nome: r.id_classe for r in labels.match_labels(names, "nome").collect()}
    assert got == {"Apple corn healthy": "apple_healthy", None: None, "Tomato___Late_blight": "tomato_late_blight"}
    with pytest.raises(ValueError):
        labels.match_labels(names, "nome", "error")


def test_signature_holds_every_name_and_size(spark):
    rows = [(1, "b", 2), (1, "a", 10), (1, "a", 3), (1, "", 0), (1, "a", 3), (1, None, 5), (2, "é|", 7), (3, None, 1), (None, "z", 1)]
    items = spark.createDataFrame(rows, "lote int, nome string, n bigint").repartition(3)
    got = {r.lote: r.assinatura for r in merge.batch_signature(items, ["lote"], "auto", 0.6, "nome").collect()}
    assert got == {1: ":0|a:3|a:3|a:10|b:2|auto|0.6", 2: "é|:7|auto|0.6", 3: None, None: "z:1|auto|0.6"}
    assert merge.batch_signature(items.limit(0), ["lote"], "auto", 0.6, "nome").collect() == []


def test_numbers_have_no_gaps_over_many_ranges(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = evaluate.numbered(d, ["k"]).collect()
    assert all(r.i == r.k for r in got) and len(got) == 1000


def test_split_shares(spark):
    d = evaluate.split_by_position(spark.range(200).withColumnRenamed("id", "i"))
    assert {r.conjunto: r["count"] for r in d.groupBy("conjunto").count().collect()} == {"treino": 140, "validação": 30, "teste": 30}


def test_report_of_class_never_predicted(spark):
    d = spark.createDataFrame([(0, 1), (1, 1)], "truth int, pred int")
    got = {r.classe: r for r in evaluate.class_report(d).collect()}
    assert (got["0"].precisao, got["0"].revocacao, got["0"].f1) == (0, 0, 0) and got["1"].revocacao == 1


def test_text(spark):
    d = spark.createDataFrame([(0.0001, None, "2024-02-03T04:05:06"), (0.8732, "", "ontem"), (None, "x", None)], "x double, t string, d string")
    got = d.select(text.decimal_comma(F.col("x")).alias("c"), text.missing_to(F.col("t"), "—").alias("m"), text.human_date(F.col("d")).alias("h")).collect()
    assert [tuple(r) for r in got] == [("0,0001", "—", "03/02/2024 às 04:05"), ("0,8732", "—", "ontem"), ("", "x", None)]
    blob = spark.createDataFrame([(b"x" * 120,)], "b binary").select(text.base64_text(F.col("b")).alias("t")).first().t
    assert "\n" not in blob and len(blob) == 160


def test_answers_that_break_the_contract(spark):
    whole = {"e_planta": True, "especie": "T", "parte_analisada": "folha", "condicao": "doente", "diagnostico": "d", "agente_causal": "a", "sintomas_observados": "s", "manejo_recomendado": "m", "confianca": "alta", "observacoes": ""}
    cases = [whole, {k: v for k, v in whole.items() if k != "especie"}, whole | {"condicao": "?"}, whole | {"confianca": "muita"}, whole | {"e_planta": None}]
    rows = [(i, str(i), json.dumps(c)) for i, c in enumerate(cases)] + [(9, "9", "no json"), (10, "10", None)]
    got = classify.parse_answers(spark.createDataFrame(rows, "pos bigint, arquivo string, resposta string"))
    assert [r.valido for r in got.orderBy("pos").collect()] == [True] + [False] * 6


def test_save_csv_and_json(spark, tmp_path):
    s = scores(spark, [(0, "á;b.png", vector(0.8732, 1)), (1, "b", vector(0.3, 2))])
    r = classify.classify(s)
    vlm = r.filter("pos = 1").withColumn("motor", F.lit(D.VLM)).withColumn("confianca", F.lit(None).cast("double"))
    csv, doc = exports.save(r.filter("pos = 0").unionByName(vlm), str(tmp_path / "out"), now=datetime.datetime(2024, 1, 2, 3, 4, 5))
    raw = csv.read_bytes()
    assert csv.name == "analise_20240102_030405.csv" and raw.startswith(b"\xef\xbb\xbf")
    lines = raw.decode("utf-8-sig").splitlines()
    assert lines[0] == ";".join(D.EXPORT_COLUMNS) and lines[1].startswith('"á;b.png";') and ";0,8732;" in lines[1]
    parsed = json.loads(doc.read_text(encoding="utf-8"))
    assert parsed["metadata"]["total_laudos"] == 2 and parsed["metadata"]["laudos_por_motor"] == {D.CNN: 1, D.VLM: 1}
    assert parsed["resultados"][1]["confianca"] == ""


def test_history(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h.total() == 0 and h.clear() == 0
    record = {"arquivo": "a", "data_hora": "2024-01-01T10:00:00", "motor": D.CNN, "especie": "", "confianca": 0.5}
    first, second = h.save(record, b"img"), h.save(record | {"arquivo": "b"})
    assert second == first + 1 and h.thumbnail(first) == b"img" and h.thumbnail(second) is None and h.get(99) is None
    assert h.delete(second) and not h.delete(second)
    assert h.save(record) == second + 1
    assert [r.id for r in h.page(1).collect()] == [second + 1] and h.page(-1).count() == 2
    assert h.records().first().especie == "—" and h.get(first)["data_legivel"] == "01/01/2024 às 10:00"
    assert h.clear() == 2 and h.total() == 0 and h.save(record) == second + 2
    with pytest.raises(ValueError):
        h.save({"arquivo": "x"})


def test_image_listing(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"\x89PNG")
    assert [r.arquivo for r in files.image_files(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_bytes(b"")
    with pytest.raises(FileNotFoundError):
        files.image_files(spark, str(tmp_path / "empty"))
    got = files.acceptable(spark.createDataFrame([(b"\x89PNG\r\n",), (b"",), (b"GIF8",), (None,)], "content binary")).collect()
    assert [r.aceito for r in got] == [True, False, False, False]




def test_remote_answers_are_all_or_nothing(spark):
    items = spark.createDataFrame([(0, "a"), (1, "bad")], "pos bigint, arquivo string")
    answers = scorers.ask_remote(items, lambda n: {"n": n} if n != "bad" else 1 / 0)
    assert answers.filter("erro IS NOT NULL").count() == 1
    with pytest.raises(merge.EngineUnavailable):
        scorers.all_or_nothing(answers)
    assert scorers.all_or_nothing(answers, partial_ok=True).count() == 1
    assert scorers.stub_scores(items).select(F.aggregate("p", F.lit(0.0), lambda a, b: a + b)).first()[0] == pytest.approx(1)


def test_drop_folder(spark, tmp_path):
    from folio.streaming.drop_folder import watch

    scores(spark, [(0, "a", vector(0.9, 1))]).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
