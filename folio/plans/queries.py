"""Each operator as a query over the contract's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import domain as D
from folio import engine
from folio.functions import ranking, text
from folio.operators import classify, evaluate, labels, merge
from folio.plans import fixtures as X
from folio.session import scratch_folder
from folio.sources import exports, files, history, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Score vectors


@query(f"WITH {X.SCORES_SQL} SELECT pos, rn::INT AS lugar, idx::INT AS idx, round(conf, 4) AS confianca FROM r WHERE rn <= 3")
def rank_top3(spark, sf):
    d = X.scores(spark, sf).select("pos", F.posexplode(ranking.top_k(F.col("p"))).alias("n", "t"))
    return d.select("pos", (F.col("n") + 1).alias("lugar"), "t.idx", F.round("t.confianca", 4).alias("confianca"))


@query(f"WITH {X.SCORES_SQL} SELECT pos, idx::INT AS idx, round(conf, 4) AS confianca FROM r WHERE rn = 2")
def rank_second(spark, sf):
    d = X.scores(spark, sf).select("pos", F.element_at(ranking.top_k(F.col("p"), 2), 2).alias("t"))
    return d.select("pos", "t.idx", F.round("t.confianca", 4).alias("confianca"))


@query(f"WITH {X.SCORES_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY conf DESC, idx) AS an FROM s) SELECT pos, idx::INT AS idx, round(conf, 4) AS confianca FROM a WHERE an = 1")
def argmax_conf(spark, sf):
    return X.scores(spark, sf).select("pos", ranking.argmax(F.col("p")).alias("idx"), F.round(F.array_max("p"), 4).alias("confianca"))


@query(f"WITH {X.SCORES_SQL} SELECT pos, idx::INT AS idx, round(conf, 8) AS p FROM s")
def softmax(spark, sf):
    return X.scores(spark, sf).select("pos", F.posexplode("p").alias("idx", "x")).select("pos", "idx", F.round("x", 8).alias("p"))


@query(f"WITH {X.CNN_SQL} SELECT pos, arquivo, especie, diagnostico, condicao, agente, sintomas, manejo, round(conf, 4) AS confianca, printf('%.1f%%', conf * 100) AS confianca_texto FROM cnn")
def threshold_classify(spark, sf):
    return X.cnn_records(spark, sf).select("pos", "arquivo", "especie", "diagnostico", "condicao", "agente", "sintomas", "manejo", F.round("confianca", 4).alias("confianca"), "confianca_texto")


_ALT = "(SELECT pos, cultura || ' — ' || diagnostico AS l, round(conf, 4) AS c FROM r JOIN cat ON r.idx = cat.idx WHERE rn = %d)"


@query(f"""WITH {X.CNN_SQL} SELECT arquivo, '{X.AS_OF}' AS data_hora, '{D.CNN}' AS motor, especie, diagnostico, condicao, round(conf, 4) AS confianca, printf('%.1f%%', conf * 100) AS confianca_texto,
 agente AS agente_causal, sintomas AS sintomas_observados, manejo AS manejo_recomendado, a.l AS alternativa_1, a.c AS confianca_alternativa_1, b.l AS alternativa_2, b.c AS confianca_alternativa_2, '' AS observacoes, 'stub v1.0.0' AS modelo_versao
 FROM cnn JOIN {_ALT % 2} a ON cnn.pos = a.pos JOIN {_ALT % 3} b ON cnn.pos = b.pos""")
def export_rows(spark, sf):
    return exports.export_rows(X.cnn_records(spark, sf))


@query(f"WITH {X.SCORES_SQL}, {X.CATALOGUE_SQL} SELECT pos, rn::INT AS lugar, cultura || ' — ' || diagnostico AS rotulo FROM r JOIN cat ON r.idx = cat.idx WHERE rn <= 3")
def alternatives_label(spark, sf):
    info = classify.class_map()
    d = X.scores(spark, sf).select("pos", F.posexplode(ranking.top_k(F.col("p"))).alias("n", "t"))
    return d.select("pos", (F.col("n") + 1).alias("lugar"), classify.label_of(F.element_at(info, F.col("t.idx"))).alias("rotulo"))


# Two engines


def _merged(spark, sf, mode):
    cnn = X.cnn_records(spark, sf)
    return merge.merge(cnn.select("pos", "arquivo"), cnn, X.vlm_records(spark, sf), mode).select("pos", "ordem", "arquivo", "motor", "diagnostico", "condicao")


_BOTH = f"WITH {X.CNN_SQL}, {X.VLM_SQL}, c AS (SELECT pos, 0 AS ordem, arquivo, '{D.CNN}' AS motor, diagnostico, condicao FROM cnn), v AS (SELECT pos, 1 AS ordem, arquivo, '{D.VLM}' AS motor, diagnostico, condicao FROM vlm)"


@query(f"{_BOTH} SELECT * FROM v UNION ALL SELECT * FROM c WHERE pos NOT IN (SELECT pos FROM v)")
def merge_auto(spark, sf):
    return _merged(spark, sf, merge.AUTO)


@query(f"{_BOTH} SELECT * FROM c UNION ALL SELECT * FROM v")
def merge_compare(spark, sf):
    return _merged(spark, sf, merge.COMPARE)


@query(f"{_BOTH} SELECT * FROM v")
def merge_vlm(spark, sf):
    return _merged(spark, sf, merge.ONLY_VLM)


@query(f"{_BOTH} SELECT * FROM c")
def merge_cnn(spark, sf):
    return _merged(spark, sf, merge.ONLY_CNN)


@query(f"WITH {X.CNN_SQL} SELECT pos, arquivo FROM cnn WHERE condicao = 'indeterminado'")
def vlm_targets(spark, sf):
    cnn = X.cnn_records(spark, sf)
    return merge.vlm_targets(cnn.select("pos", "arquivo"), cnn).select("pos", "arquivo")


@query(f"WITH {X.CNN_SQL}, k AS (SELECT pos, 'n' || (pos % 400) AS arquivo, diagnostico FROM cnn) SELECT k.pos, k.arquivo, j.diagnostico FROM k JOIN (SELECT arquivo, arg_max(diagnostico, pos) AS diagnostico FROM k GROUP BY arquivo) j ON k.arquivo = j.arquivo")
def dup_names(spark, sf):
    cnn = X.cnn_records(spark, sf).withColumn("arquivo", F.concat(F.lit("n"), (F.col("pos") % 400).cast("string")))
    return merge.merge(cnn.select("pos", "arquivo"), cnn, cnn.limit(0), merge.ONLY_CNN).select("pos", "arquivo", "diagnostico")


@query(f"{_BOTH}, a AS (SELECT * FROM c UNION ALL SELECT * FROM v) SELECT arquivo, min(pos) AS primeira, string_agg(motor, ',' ORDER BY pos, ordem) AS motores FROM a GROUP BY arquivo")
def group_by_file(spark, sf):
    return merge.group_by_file(_merged(spark, sf, merge.COMPARE))


@query(f"{_BOTH}, a AS (SELECT * FROM c UNION ALL SELECT * FROM v) SELECT pos, ordem, arquivo, motor, (row_number() OVER (PARTITION BY arquivo ORDER BY motor <> '{D.CNN}', pos, ordem))::INT AS lugar FROM a")
def engine_order(spark, sf):
    return merge.display_order(_merged(spark, sf, merge.COMPARE)).select("pos", "ordem", "arquivo", "motor", "lugar")


_COUNTS = "count(*) AS total_laudos, count(DISTINCT arquivo) AS total_imagens, count(*) FILTER (condicao = 'saudável') AS saudaveis, count(*) FILTER (condicao = 'doente') AS doentes, count(*) FILTER (condicao = 'indeterminado') AS indeterminados"
_ENGINES = f"count(*) FILTER (motor = '{D.CNN}') AS do_cnn, count(*) FILTER (motor = '{D.VLM}') AS do_vlm"


@query(f"{_BOTH}, a AS (SELECT * FROM c UNION ALL SELECT * FROM v) SELECT {_COUNTS}, {_ENGINES} FROM a")
def batch_summary(spark, sf):
    return merge.summary(_merged(spark, sf, merge.COMPARE))


@query(f"{_BOTH}, a AS (SELECT * FROM v UNION ALL SELECT * FROM c WHERE pos NOT IN (SELECT pos FROM v)) SELECT {_COUNTS.partition('saudaveis')[0].rpartition(',')[0]}, {_ENGINES} FROM a")
def export_metadata(spark, sf):
    return merge.summary(_merged(spark, sf, merge.AUTO)).select("total_laudos", "total_imagens", "do_cnn", "do_vlm")


@query(f"WITH {X.CNN_SQL}, d(condicao) AS (VALUES ('saudável'), ('doente'), ('indeterminado')) SELECT d.condicao, count(cnn.pos) AS n FROM d LEFT JOIN cnn ON cnn.condicao = d.condicao GROUP BY d.condicao")
def count_by_condition(spark, sf):
    s = merge.summary(X.cnn_records(spark, sf).withColumn("ordem", F.lit(0)))
    pairs = F.array(*[F.struct(F.lit(c).alias("condicao"), F.col(n).alias("n")) for c, n in zip(D.CONDITIONS, ["saudaveis", "doentes", "indeterminados"], strict=True)])
    return s.select(F.explode(pairs).alias("p")).select("p.*")


@query(f"{_BOTH}, a AS (SELECT motor FROM c UNION ALL SELECT motor FROM v) SELECT motor, count(*) AS n FROM a GROUP BY motor")
def count_by_engine(spark, sf):
    s = merge.summary(_merged(spark, sf, merge.COMPARE))
    pairs = F.array(*[F.struct(F.lit(m).alias("motor"), F.col(n).alias("n")) for m, n in ((D.CNN, "do_cnn"), (D.VLM, "do_vlm"))])
    return s.select(F.explode(pairs).alias("p")).select("p.*")


# Labels and splits


@query(f"WITH {X.NAMES_SQL} SELECT nome, normal FROM nn")
def label_normalise(spark, sf):
    return X.label_names(spark, sf).select("nome", text.normalise(F.col("nome")).alias("normal"))


@query(f"WITH {X.HITS_SQL}, {X.CATALOGUE_SQL} SELECT nm.nome, h.idx, cat.id AS id_classe FROM nm LEFT JOIN (SELECT nome, min(idx) AS idx FROM hits GROUP BY nome) h ON nm.nome = h.nome LEFT JOIN cat ON cat.idx = h.idx")
def label_match_first(spark, sf):
    return labels.match_labels(X.label_names(spark, sf), "nome")


@query(f"WITH {X.HITS_SQL} SELECT nome, count(*)::INT AS n FROM hits GROUP BY nome HAVING count(*) > 1")
def label_match_ambiguous(spark, sf):
    return labels.ambiguous_labels(X.label_names(spark, sf), "nome")


@query("SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN label // 2 ELSE -1 END AS remap FROM embeddings")
def label_remap(spark, sf):
    kept = {k: k // 2 for k in range(0, 12, 2)}
    return X.table(spark, sf, "embeddings").select("vec_id", "label", labels.remapped(F.col("label"), kept).alias("remap"))


def _split(rows):
    return evaluate.split_by_position(evaluate.numbered(rows, ["lang", "doc_id"]))


def _split_kept(spark, sf):
    """Filtered first, then numbered: places are those among the languages that are kept."""
    return _split(X.splits(spark, sf).filter(F.col("lang") != "es"))


@query(f"WITH {X.SPLIT_SQL} SELECT doc_id, lang, i, conjunto FROM sp")
def split_assign(spark, sf):
    return _split_kept(spark, sf)


@query(f"WITH {X.SPLIT_SQL} SELECT lang, count(*) FILTER (conjunto = 'treino') AS treino, count(*) FILTER (conjunto = 'validação') AS validacao, count(*) FILTER (conjunto = 'teste') AS teste, count(*) AS total, round(100 * count(*) FILTER (conjunto = 'treino') / count(*), 1) AS pct_treino FROM sp GROUP BY lang")
def split_crosstab(spark, sf):
    return evaluate.split_crosstab(_split_kept(spark, sf), "lang")


@query(f"WITH {X.HITS_SQL}, {X.CATALOGUE_SQL} SELECT nm.nome, h.idx, cat.id AS id_classe FROM nm JOIN (SELECT nome, min(idx) AS idx FROM hits GROUP BY nome) h ON nm.nome = h.nome JOIN cat ON cat.idx = h.idx")
def label_filter(spark, sf):
    return labels.kept_labels(X.label_names(spark, sf), "nome")


@query(f"WITH {X.SPLIT_ALL_SQL} SELECT count(*) FILTER (conjunto = 'treino') AS treino, count(*) FILTER (conjunto = 'validação') AS validacao, count(*) FILTER (conjunto = 'teste') AS teste FROM sp")
def split_sizes(spark, sf):
    return evaluate.split_sizes(_split(X.splits(spark, sf)))


@query("""WITH h AS (SELECT r_name AS metrica, list(n_nationkey ORDER BY n_nationkey) FILTER (n_nationkey < 12) AS a, list(n_nationkey ORDER BY n_nationkey DESC) FILTER (n_nationkey >= 12) AS b FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
 SELECT metrica, array_to_string(list_concat(coalesce(a, []), coalesce(b, [])), ',') AS valores FROM h""")
def joined_histories(spark, sf):
    n = X.table(spark, sf, "nation").join(X.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    phase = lambda rows, ascending: rows.groupBy(F.col("r_name").alias("metrica")).agg(F.sort_array(F.collect_list("n_nationkey"), ascending).alias("valores"))
    both = evaluate.joined_histories(phase(n.filter("n_nationkey < 12"), True), phase(n.filter("n_nationkey >= 12"), False))
    return both.select("metrica", F.array_join(F.col("valores").cast("array<string>"), ",").alias("valores"))


@query("SELECT doc_id, (i // 32)::BIGINT AS lote, (i % 32)::BIGINT AS lugar FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def loader_batches(spark, sf):
    return evaluate.batches(X.table(spark, sf, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "lote", "lugar")


# Evaluation


@query(f"""WITH {X.PRED_SQL}, k AS (SELECT truth AS c FROM pr UNION SELECT pred FROM pr),
 t AS (SELECT c, (SELECT count(*) FROM pr WHERE truth = c) AS t, (SELECT count(*) FROM pr WHERE pred = c) AS p, (SELECT count(*) FROM pr WHERE pred = c AND truth = c) AS tp FROM k)
 SELECT (SELECT round(avg((pred = truth)::INT), 8) FROM pr) AS acuracia_teste, (SELECT count(*) FROM pr) AS imagens_teste, 70::BIGINT AS imagens_treino, 0.6::DOUBLE AS limiar_confianca,
 count(*) AS classes, round(avg(2 * tp / (t + p)), 8) AS macro_f1, round(sum(t * 2 * tp / (t + p)) / sum(t), 8) AS weighted_f1, (SELECT round(avg((pred = truth)::INT), 8) FROM pr) AS accuracy FROM t""")
def metrics_document(spark, sf):
    m = evaluate.metrics(X.predictions(spark, sf), 70, 0.6)
    by_class = m.pop("por_classe")
    f1 = [round(by_class.pop(k)["f1-score"], 8) for k in ("macro avg", "weighted avg")]
    overall = round(by_class.pop("accuracy"), 8)
    row = (round(m["acuracia_teste"], 8), m["imagens_teste"], m["imagens_treino"], m["limiar_confianca"], len(by_class), *f1, overall)
    return spark.createDataFrame([row], "acuracia_teste double, imagens_teste bigint, imagens_treino bigint, limiar_confianca double, classes bigint, macro_f1 double, weighted_f1 double, accuracy double")


@query(f"WITH {X.PRED_SQL} SELECT round(avg((pred = truth)::INT), 8) AS acuracia FROM pr")
def accuracy(spark, sf):
    return evaluate.accuracy(X.predictions(spark, sf)).select(F.round("acuracia", 8).alias("acuracia"))


@query(f"""WITH {X.PRED_SQL}, k AS (SELECT truth AS c FROM pr UNION SELECT pred FROM pr),
 t AS (SELECT c, (SELECT count(*) FROM pr WHERE truth = c) AS t, (SELECT count(*) FROM pr WHERE pred = c) AS p, (SELECT count(*) FROM pr WHERE pred = c AND truth = c) AS tp FROM k),
 u AS (SELECT c::VARCHAR AS classe, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precisao, CASE WHEN t = 0 THEN 0 ELSE tp / t END AS revocacao, 2 * tp / (t + p) AS f1, t AS suporte FROM t)
 SELECT classe, round(precisao, 8) AS precisao, round(revocacao, 8) AS revocacao, round(f1, 8) AS f1, suporte::BIGINT AS suporte FROM u
 UNION ALL SELECT 'macro avg', round(avg(precisao), 8), round(avg(revocacao), 8), round(avg(f1), 8), sum(suporte)::BIGINT FROM u
 UNION ALL SELECT 'weighted avg', round(sum(precisao * suporte) / sum(suporte), 8), round(sum(revocacao * suporte) / sum(suporte), 8), round(sum(f1 * suporte) / sum(suporte), 8), sum(suporte)::BIGINT FROM u""")
def class_report(spark, sf):
    return evaluate.class_report(X.predictions(spark, sf)).select("classe", *[F.round(c, 8).alias(c) for c in ("precisao", "revocacao", "f1")], "suporte")


@query(f"WITH {X.PRED_SQL}, g AS (SELECT a.range AS truth, b.range AS pred FROM range(10) a, range(10) b) SELECT g.truth::INT AS truth, g.pred::INT AS pred, round(coalesce((SELECT count(*) FROM pr WHERE pr.truth = g.truth AND pr.pred = g.pred) / nullif((SELECT count(*) FROM pr WHERE pr.truth = g.truth), 0), 0), 8) AS fracao FROM g")
def confusion_norm(spark, sf):
    return evaluate.confusion(X.predictions(spark, sf), 10).select("truth", "pred", F.round("fracao", 8).alias("fracao"))


@query(f"WITH {X.PRED_SQL} SELECT round(avg(conf) FILTER (pred = truth), 8) AS media_acertos, round(avg(conf) FILTER (pred <> truth), 8) AS media_erros FROM pr")
def conf_by_outcome(spark, sf):
    return evaluate.confidence_by_outcome(X.predictions(spark, sf)).select(F.round("media_acertos", 8).alias("media_acertos"), F.round("media_erros", 8).alias("media_erros"))


@query(f"WITH {X.PRED_SQL}, t(limiar) AS (VALUES (0.4::DOUBLE), (0.6::DOUBLE)) SELECT limiar, count(*) FILTER (pred = truth AND conf < limiar) AS acertos_rejeitados, round(avg((pred = truth AND conf < limiar)::INT), 8) AS fracao_rejeitada, count(*) FILTER (pred <> truth AND conf < limiar) AS erros_bloqueados FROM pr, t GROUP BY limiar")
def threshold_coverage(spark, sf):
    return evaluate.threshold_coverage(X.predictions(spark, sf), [0.4, 0.6]).withColumn("fracao_rejeitada", F.round("fracao_rejeitada", 8))


# History


def _log(spark, sf, clear_at: int | None = None):
    rows = X.laudos(spark, sf)
    insert = rows.select((F.col("id") * 2).alias("seq"), F.lit("insert").alias("op"), "*")
    marks = rows.filter("motor = 'error'").select((F.col("id") * 2 + 1).alias("seq"), F.lit("delete").alias("op"), "id")
    log = insert.unionByName(marks, allowMissingColumns=True)
    if clear_at is not None:
        log = log.unionByName(spark.createDataFrame([(2 * clear_at + 1, "clear", None)], "seq bigint, op string, id bigint"), allowMissingColumns=True)
    return log


_NOW = f"WITH {X.LAUDOS_SQL}, h AS (SELECT * FROM l WHERE motor <> 'error')"


@query(f"{_NOW} SELECT id, arquivo, data_hora, strftime(strptime(data_hora, '%Y-%m-%dT%H:%M:%S'), '%d/%m/%Y às %H:%M') AS data_legivel, motor FROM h ORDER BY id DESC LIMIT 60")
def history_page(spark, sf):
    d = history.current(_log(spark, sf)).select("id", "arquivo", "data_hora", text.human_date(F.col("data_hora")).alias("data_legivel"), "motor")
    return d.orderBy(F.desc("id")).limit(60)


@query(f"{_NOW} SELECT id, arquivo, data_hora, motor, coalesce(nullif(especie, ''), '—') AS especie, coalesce(condicao, '') AS condicao, round(confianca, 4) AS confianca FROM h")
def history_all(spark, sf):
    d = history.filled(history.current(_log(spark, sf)))
    return d.select("id", "arquivo", "data_hora", "motor", "especie", "condicao", F.round("confianca", 4).alias("confianca"))


@query(f"{_NOW} SELECT id, arquivo, motor FROM h WHERE id = 43")
def history_get(spark, sf):
    return history.current(_log(spark, sf)).filter("id = 43").select("id", "arquivo", "motor")


@query(f"{_NOW} SELECT id, props AS miniatura FROM h WHERE id = 43")
def history_thumb(spark, sf):
    return history.current(_log(spark, sf)).filter("id = 43").select("id", F.decode("miniatura", "UTF-8").alias("miniatura"))


@query(f"{_NOW} SELECT id, motor FROM h")
def history_delete(spark, sf):
    return history.current(_log(spark, sf)).select("id", "motor")


@query(f"{_NOW} SELECT id, motor FROM h WHERE id > 500")
def history_clear(spark, sf):
    return history.current(_log(spark, sf, clear_at=500)).select("id", "motor")


@query(f"{_NOW} SELECT count(*) AS total FROM h")
def history_total(spark, sf):
    return history.current(_log(spark, sf)).agg(F.count("*").alias("total"))


@query(f"""WITH {X.LAUDOS_SQL}, i AS (SELECT row_number() OVER (ORDER BY l.id % 3, l.id) AS novo, l.* FROM l)
 SELECT novo AS id, arquivo, data_hora, motor, especie, round(confianca, 4) AS confianca, CASE WHEN novo <= (SELECT count(*) FROM l WHERE l.id % 3 < 2) THEN props END AS miniatura FROM i WHERE novo NOT IN (2, 5, 11)""")
def history_store(spark, sf):
    """Three batches and three deletes, written anew after the second: what is there then, with pictures."""
    h, rows = history.History(spark, scratch_folder(spark, "history")), X.laudos(spark, sf).withColumnRenamed("id", "pos")
    for k in range(3):
        batch = rows.filter(F.col("pos") % 3 == k)
        h.save_all(batch.drop("miniatura"), batch.select("pos", "miniatura") if k < 2 else None)
        h.delete((2, 5, 11)[k])
        if k == 1:
            h.compact()
    kept = h.rows.join(h.thumbnails(), "id", "left")
    return kept.select("id", "arquivo", "data_hora", "motor", "especie", F.round("confianca", 4).alias("confianca"), F.decode("miniatura", "UTF-8").alias("miniatura"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y às %H:%M') AS data_legivel, 'sem data ' || o_orderkey AS sem_data FROM orders")
def human_date(spark, sf):
    o = X.table(spark, sf, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", text.human_date(iso).alias("data_legivel"), text.human_date(F.concat(F.lit("sem data "), F.col("o_orderkey").cast("string"))).alias("sem_data"))


# Text


@query(f"WITH {X.SCORES_SQL} SELECT pos, printf('%.1f%%', conf * 100) AS uma_casa, printf('%.2f%%', conf * 100) AS duas_casas, floor(conf * 100 + 0.5)::INT AS inteiro FROM r WHERE rn = 1")
def pct_text(spark, sf):
    top = F.array_max("p")
    return X.scores(spark, sf).select("pos", text.percent(top).alias("uma_casa"), text.percent(top, 2).alias("duas_casas"), text.integer_percent(top).alias("inteiro"))


@query(f"WITH {X.SCORES_SQL} SELECT pos, idx::INT AS idx, replace(regexp_replace(regexp_replace(printf('%.4f', round(conf, 4)), '0+$', ''), '\\.$', '.0'), '.', ',') AS texto FROM s")
def csv_decimal(spark, sf):
    return X.scores(spark, sf).select("pos", F.posexplode("p").alias("idx", "x")).select("pos", "idx", text.decimal_comma(F.col("x")).alias("texto"))


@query("SELECT c_custkey, concat_ws(' · ', nullif(nullif(CASE WHEN c_custkey % 3 = 0 THEN '—' ELSE c_name END, ''), '—'), nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, '')) AS linha FROM customer")
def detail_line(spark, sf):
    c = X.table(spark, sf, "customer")
    return c.select("c_custkey", text.detail_line(F.when(F.col("c_custkey") % 3 == 0, "—").otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))).alias("linha"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escapado FROM pages")
def html_escape(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escapado"))


@query(f"WITH {X.SCORES_SQL} SELECT pos, printf('%.2f%%', least(conf * 1.5, 1) * 100) AS barra FROM r WHERE rn = 1")
def clamped_percent(spark, sf):
    return X.scores(spark, sf).select("pos", text.clamped_percent(F.array_max("p") * 1.5).alias("barra"))


@query("SELECT p_partkey, '[' || rpad(p_name, greatest(24, length(p_name))::INT, ' ') || ']' AS coluna, split_part(p_name || chr(10) || 'x', chr(10), 1) AS linha FROM part")
def padded_column(spark, sf):
    name = F.col("p_name")
    return X.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("["), text.padded(name, 24), F.lit("]")).alias("coluna"), text.first_line(F.concat(name, F.lit("\nx"))).alias("linha"))


@query("SELECT p_partkey, tipo, regexp_matches(lower(tipo), '^image/(png|jpe?g)$') AS imagem FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/PNG' WHEN 1 THEN 'IMAGE/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/jpg' ELSE 'text/image/png' END AS tipo FROM part)")
def mime_filter(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["image/PNG", "IMAGE/jpeg", "image/gif", "image/jpg", "text/image/png"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return X.table(spark, sf, "part").select("p_partkey", kind.alias("tipo"), text.is_image_type(kind).alias("imagem"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html || '(&)' || chr(39), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')) AS escapado FROM pages")
def html_escape_script(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", F.md5(text.html_escape(F.concat("html", F.lit("(&)'")), "&#39;")).alias("escapado"))


# Files


@query(f"WITH {X.PATHS_SQL} SELECT caminho FROM pa WHERE NOT (list_has_any(string_split(caminho, '/'), [{', '.join(map(X.quoted, D.EXCLUDED_DIRS))}]) OR regexp_extract(caminho, '[^/]*$') IN ({', '.join(map(X.quoted, D.EXCLUDED_FILES))}) OR starts_with(regexp_extract(caminho, '[^/]*$'), '~$') OR regexp_matches(lower(caminho), '[^/.][^/]*\\.(pyc|zip|pdf)$'))")
def path_filter(spark, sf):
    return files.package_files(X.paths(spark, sf))


@query(f"WITH {X.PATHS_SQL} SELECT caminho FROM pa WHERE ends_with(caminho, '.env') OR ends_with(caminho, 'historico.db')")
def leak_audit(spark, sf):
    return files.leaks(X.paths(spark, sf))


@query(f"WITH {X.PATHS_SQL} SELECT DISTINCT split_part(caminho, '/', 1) AS entrada FROM pa")
def top_level_entries(spark, sf):
    return files.top_level(X.paths(spark, sf))


_TREE = """t AS (SELECT s_suppkey AS k, 's' || (s_suppkey % 7) || '/' || CASE s_suppkey % 5 WHEN 0 THEN '.git/' WHEN 1 THEN '_build/x/' WHEN 2 THEN '' WHEN 3 THEN 'node_modules/m/' ELSE 'src/' END
  || CASE s_suppkey % 4 WHEN 0 THEN '.env' WHEN 1 THEN '_f.PY' WHEN 2 THEN 'historico.db' ELSE 'r.csv' END || CASE WHEN s_suppkey % 8 < 4 THEN '' ELSE s_suppkey::VARCHAR END AS caminho FROM supplier),
 ft AS (SELECT caminho, max(10 + length(caminho)) AS length FROM t GROUP BY caminho)"""


def _planted_tree(spark, sf) -> str:
    """A folder of files that are named after suppliers, hidden names among them."""
    k = F.col("s_suppkey")
    folder = F.element_at(F.array(*map(F.lit, [".git/", "_build/x/", "", "node_modules/m/", "src/"])), (k % 5 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, [".env", "_f.PY", "historico.db", "r.csv"])), (k % 4 + 1).cast("int"))
    path = F.concat(F.lit("s"), (k % 7).cast("string"), F.lit("/"), folder, name, F.when(k % 8 < 4, "").otherwise(k.cast("string")))
    rows = X.table(spark, sf, "supplier").select(path.alias("caminho")).distinct().select("caminho", (F.length("caminho") + 10).alias("length"))
    root = scratch_folder(spark, "tree")
    tree.planted(rows, root)
    return root


@query(f"WITH {_TREE} SELECT caminho, length::BIGINT AS length, ends_with(caminho, '.env') OR ends_with(caminho, 'historico.db') AS vazado FROM ft")
def file_listing(spark, sf):
    root = _planted_tree(spark, sf)
    found = files.all_files(spark, root)
    return found.join(files.leaks(found).select("caminho", F.lit(True).alias("v")), "caminho", "left").select("caminho", "length", F.coalesce("v", F.lit(False)).alias("vazado"))


@query(f"WITH {_TREE} SELECT caminho, length::BIGINT AS length FROM ft WHERE starts_with(caminho, 's1/') AND ends_with(caminho, '.PY') AND NOT contains(caminho, '.git/') AND NOT contains(caminho, 'node_modules/')")
def file_listing_pruned(spark, sf):
    found = tree.file_tree(spark, _planted_tree(spark, sf), D.EXCLUDED_DIRS)
    return found.filter(F.col("caminho").startswith("s1/") & (F.col("sufixo") == ".py")).select("caminho", "length")


@query("SELECT p_partkey, nome FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.gif' ELSE '.png.txt' END AS nome FROM part) WHERE regexp_matches(lower(nome), '\\.(png|jpe?g)$')")
def ext_filter(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, ".PNG").when(k == 1, ".jpeg").when(k == 2, ".gif").otherwise(".png.txt"))
    return X.table(spark, sf, "part").select("p_partkey", name.alias("nome")).filter(F.col("nome").rlike(files.IMAGE))


# Remote answers


@query(f"WITH {X.ANSWERS_SQL} SELECT pos, arquivo, valido FROM an")
def vlm_validate(spark, sf):
    return classify.parse_answers(X.answers(spark, sf)).select("pos", "arquivo", "valido")


@query(f"""WITH {X.ANSWERS_SQL} SELECT pos, arquivo, CASE WHEN e_planta THEN 'Tomate' ELSE '—' END AS especie, CASE WHEN e_planta THEN 'd' || pos ELSE 'Não é uma planta' END AS diagnostico, CASE WHEN e_planta THEN condicao ELSE 'indeterminado' END AS condicao,
 CASE WHEN e_planta THEN confianca || ' (autoavaliada)' ELSE '—' END AS confianca_texto, '—' AS agente, CASE WHEN e_planta THEN 'podar' ELSE {X.quoted(D.NO_PLANT['manejo'])} END AS manejo, CASE WHEN toxic <> 1 THEN 'manchas' WHEN e_planta THEN '' ELSE {X.quoted(D.NO_PLANT_SYMPTOMS)} END AS sintomas,
 CASE WHEN e_planta THEN 'Parte analisada: folha' || CASE WHEN observacoes = '' THEN '' ELSE ' · ' || observacoes END ELSE observacoes END AS observacoes FROM an WHERE valido""")
def vlm_record(spark, sf):
    parsed = classify.parse_answers(X.answers(spark, sf)).filter("valido")
    return classify.answers_to_records(parsed, X.AS_OF).select("pos", "arquivo", "especie", "diagnostico", "condicao", "confianca_texto", "agente", "manejo", "sintomas", "observacoes")


_FIELDS = [c for c in D.RECORD.names if c != "ranking"]


@query(f"""WITH {X.CNN_SQL}, k AS (SELECT pos, string_agg(cultura || ' — ' || diagnostico || '=' || printf('%.4f', round(conf, 4)), '|' ORDER BY rn) AS ranking FROM r JOIN cat ON r.idx = cat.idx WHERE rn <= 3 GROUP BY pos)
 SELECT cnn.pos, row_number() OVER (ORDER BY cnn.pos) AS id_historico, arquivo, '{X.AS_OF}' AS data_hora, '{D.CNN}' AS motor, especie, diagnostico, condicao, round(conf, 4) AS confianca, printf('%.1f%%', conf * 100) AS confianca_texto,
 agente, sintomas, manejo, 'stub v1.0.0' AS modelo_versao, '' AS observacoes, k.ranking FROM cnn JOIN k ON cnn.pos = k.pos""")
def api_document(spark, sf):
    unavailable = lambda _: X.cnn_records(spark, sf).limit(0)
    batch = engine.Engine(spark, scratch_folder(spark, "history"), lambda i: classify.classify(i, as_of=X.AS_OF), unavailable)
    records, _ = batch.analyse(X.scores(spark, sf).select("pos", "arquivo", "p"), merge.ONLY_CNN)
    fields = ", ".join(f"{c} {'double' if c == 'confianca' else 'string'}" for c in _FIELDS)
    doc = engine.serialised(records).select("pos", F.from_json("documento", f"id_historico bigint, {fields}, ranking array<struct<rotulo string, confianca double>>").alias("d"))
    shown = F.array_join(F.transform("d.ranking", lambda r: F.concat(r["rotulo"], F.lit("="), F.format_string("%.4f", F.round(r["confianca"], 4)))), "|")
    return doc.select("pos", "d.id_historico", *[F.round("d.confianca", 4).alias(c) if c == "confianca" else f"d.{c}" for c in _FIELDS], shown.alias("ranking"))


@query(f"WITH {X.CNN_SQL} SELECT pos, CASE condicao WHEN 'saudável' THEN 'selo-saudavel' WHEN 'doente' THEN 'selo-doente' ELSE 'selo-indeterminado' END AS selo, 'selo-indeterminado' AS outro FROM cnn")
def display_class(spark, sf):
    return X.cnn_records(spark, sf).select("pos", classify.display_class(F.col("condicao")).alias("selo"), classify.display_class(F.concat("condicao", F.lit("?"))).alias("outro"))


@query(f"WITH {X.SCORES_SQL}, {X.CATALOGUE_SQL} SELECT pos, rn::INT AS lugar, cultura, diagnostico, condicao, manejo FROM r JOIN cat ON r.idx = cat.idx WHERE rn <= 3")
def catalogue_lookup(spark, sf):
    d = X.cnn_records(spark, sf).select("pos", F.posexplode("ranking").alias("n", "t")).select("pos", (F.col("n") + 1).alias("lugar"), "t.id_classe")
    return classify.with_class(d).select("pos", "lugar", "info.cultura", "info.diagnostico", "info.condicao", "info.manejo")


@query("SELECT source, count(*) AS entradas, sum(n_chars)::BIGINT AS bytes, printf('%.1f KB', floor(sum(n_chars) * 10 / 1024) / 10) AS texto FROM documents GROUP BY source")
def size_totals(spark, sf):
    d = X.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("entradas"), F.sum("n_chars").alias("bytes"))
    return d.withColumn("texto", text.file_size(F.col("bytes")))


@query("SELECT s_suppkey, ((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 3)::INT AS linha FROM supplier")
def page_groups(spark, sf):
    return merge.in_rows_of(X.table(spark, sf, "supplier"), "s_nationkey", "s_suppkey").select("s_suppkey", "linha")


@query("SELECT n_regionkey, string_agg(n_name || ':' || length(n_name), '|' ORDER BY n_name) || '|auto|0.6' AS assinatura FROM nation GROUP BY n_regionkey")
def batch_signature(spark, sf):
    return merge.batch_signature(X.table(spark, sf, "nation").withColumn("n", F.length("n_name")), ["n_regionkey"], "auto", 0.6)


@query("SELECT p_partkey, coalesce(nullif(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' WHEN p_partkey % 3 = 1 THEN 'MUDE' ELSE ' ' || p_brand END), ''), 'MUDE'), 'desconhecida') || ' v' || p_size AS versao FROM part")
def model_version(spark, sf):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, "  ").when(k == 1, "MUDE").otherwise(F.concat(F.lit(" "), "p_brand"))
    return X.table(spark, sf, "part").select("p_partkey", text.model_version(raw, F.col("p_size"), "MUDE").alias("versao"))
