"""The contract's tables, shaped as what the operators take; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import domain as D
from folio.functions.ranking import softmax
from folio.operators.classify import classify

AS_OF = "2024-01-01T00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, arquivo, truth, p): softmax of 15 times the first 12 components of an embedding."""
    logits = F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double") * 15.0)
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.concat(F.lit("img_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("arquivo"), F.col("label").alias("truth"), logits.alias("z"))
    return d.withColumn("p", softmax(F.col("z"))).drop("z")


def cnn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(scores(spark, sf_dir), as_of=AS_OF)


def vlm_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second engine's records: none where pos % 7 = 0, the condition by truth % 3."""
    s = scores(spark, sf_dir).filter(F.col("pos") % 7 != 0)
    condition = F.element_at(F.array(*map(F.lit, D.CONDITIONS)), F.col("truth") % 3 + 1)
    values = {"data_hora": F.lit(AS_OF), "motor": F.lit(D.VLM), "especie": F.lit("Planta"), "diagnostico": F.concat(F.lit("d"), F.col("truth").cast("string")), "condicao": condition, "confianca": F.lit(None).cast("double"), "confianca_texto": F.lit("alta (autoavaliada)"), "ranking": F.array().cast(D.RANKING)}
    return s.select("pos", "arquivo", *[values.get(c, F.lit("")).alias(c) for c in D.RECORD.names if c != "arquivo"])


def laudos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows from events; views have no type, errors are deleted."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("arquivo"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("data_hora"), F.col("event_type").alias("motor"), F.nullif(F.col("event_type"), F.lit("view")).alias("especie"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("condicao"), (F.col("value") / 500).alias("confianca"), F.encode(F.col("props"), "UTF-8").alias("miniatura"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the order of language and id: (doc_id, lang)."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, truth, pred, conf): a prediction of the label from the first ten components."""
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").alias("truth"), softmax(F.transform(z, lambda x: x * 15.0)).alias("p"))
    return d.select("pos", "truth", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("pred"), F.array_max("p").alias("conf"))


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nome): part names and types, and a label for each class and some that match none or two."""
    part = table(spark, sf_dir, "part")
    return spark.createDataFrame([(n,) for n in LABEL_NAMES], "nome string").union(part.select("p_name")).union(part.select("p_type")).distinct()


LABEL_NAMES = ["Apple___healthy", "Apple___Apple_scab", "Corn_(maize)___Common_rust", "Grape___Black_rot", "Potato___Early_blight", "Tomato___Late_blight", "Tomato Septoria leaf-spot", "Tomato__Spider_mites", "Rose", "Apple corn healthy", "Maçã ² Saudável", ""]
PATHS = ["src/a.py", ".git/config", "docs/.env", "x/~$lock.docx", "b/Report.PDF", "historico.db", "a/historico.db", "node_modules/m/i.js", "README.md", "entrega/x.txt", "c/d.zip", "web/app.js", "data/v.env"]


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caminho): URL paths of pages, and paths as packages have them."""
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("caminho"))
    return urls.union(spark.createDataFrame([(p,) for p in PATHS], "caminho string"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, arquivo, resposta): JSON answers; some lack a field, leave a domain or aren't JSON."""
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), "quality", "toxic")
    pos = F.col("pos").cast("string")
    fields = {"e_planta": F.col("pos") % 5 != 0, "especie": F.lit("Tomate"), "parte_analisada": F.lit("folha"), "condicao": F.when(F.col("pos") % 11 == 0, "ruim").when(F.col("quality") == 1, D.HEALTHY).otherwise(D.DISEASED), "diagnostico": F.concat(F.lit("d"), pos), "agente_causal": F.lit("—"), "sintomas_observados": F.when(F.col("toxic") == 1, "").otherwise("manchas"), "manejo_recomendado": F.lit("podar"), "confianca": F.when(F.col("pos") % 3 == 0, "alta").otherwise("média"), "observacoes": F.when(F.col("pos") % 13 == 0, F.lit(None)).when(F.col("pos") % 2 == 0, "").otherwise("obs")}
    whole = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return d.select("pos", F.concat(F.lit("a"), pos).alias("arquivo"), F.when(F.col("pos") % 17 == 0, "{").otherwise(whole).alias("resposta"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CATALOGUE_SQL = "cat(idx, id, cultura, diagnostico, condicao, agente, sintomas, manejo) AS (VALUES " + ", ".join(f"({i}, {', '.join(quoted(v) for v in (c[0], *c[2:]))})" for i, c in enumerate(D.CATALOGUE)) + ")"
PATTERNS_SQL = "pat(idx, pattern) AS (VALUES " + ", ".join(f"({i}, {quoted(p)})" for i, c in enumerate(D.CATALOGUE) for p in c[1]) + ")"
SCORES_SQL = """e AS (SELECT vec_id, label, unnest(range(1, 13)) AS k, embedding FROM embeddings),
 z AS (SELECT vec_id AS pos, label AS truth, k - 1 AS idx, 15.0::DOUBLE * embedding[k]::DOUBLE AS z FROM e),
 m AS (SELECT pos, max(z) AS m FROM z GROUP BY pos),
 w AS (SELECT z.pos, truth, idx, exp(z - m) AS w FROM z JOIN m ON z.pos = m.pos),
 s AS (SELECT pos, 'img_' || pos || '.jpg' AS arquivo, truth, idx, w / sum(w) OVER (PARTITION BY pos) AS conf FROM w),
 r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY conf DESC, idx DESC) AS rn FROM s)"""
CNN_SQL = f"""{SCORES_SQL}, {CATALOGUE_SQL},
 cnn AS (SELECT r.pos, arquivo, truth, r.conf,
  CASE WHEN conf < 0.6 THEN '—' ELSE cultura END AS especie,
  CASE WHEN conf < 0.6 THEN 'Indeterminado' ELSE diagnostico END AS diagnostico,
  CASE WHEN conf < 0.6 THEN 'indeterminado' ELSE condicao END AS condicao,
  CASE WHEN conf < 0.6 THEN '—' ELSE agente END AS agente,
  CASE WHEN conf < 0.6 THEN {quoted(D.OUT_OF_DOMAIN % '60%')} ELSE sintomas END AS sintomas,
  CASE WHEN conf < 0.6 THEN {quoted(D.OUT_OF_DOMAIN_ADVICE)} ELSE manejo END AS manejo
  FROM r JOIN cat ON r.idx = cat.idx WHERE rn = 1)"""
VLM_SQL = """vlm AS (SELECT DISTINCT pos, arquivo, 'd' || truth AS diagnostico,
  CASE truth % 3 WHEN 0 THEN 'saudável' WHEN 1 THEN 'doente' ELSE 'indeterminado' END AS condicao FROM s WHERE pos % 7 <> 0)"""
LAUDOS_SQL = "l AS (SELECT event_id AS id, 'f' || user_id AS arquivo, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS data_hora, event_type AS motor, nullif(event_type, 'view') AS especie, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS condicao, value / 500 AS confianca, props FROM events)"
_PLACES_SQL = "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS i FROM documents"
_SETS_SQL = "sp AS (SELECT *, CASE WHEN i % 20 < 3 THEN 'teste' WHEN i % 20 < 6 THEN 'validação' ELSE 'treino' END AS conjunto FROM n)"
SPLIT_SQL = f"n AS ({_PLACES_SQL} WHERE lang <> 'es'),\n {_SETS_SQL}"
SPLIT_ALL_SQL = f"n AS ({_PLACES_SQL}),\n {_SETS_SQL}"
PRED_SQL = """e AS (SELECT vec_id AS pos, label AS truth, unnest(range(1, 11)) AS k, embedding FROM embeddings),
 z AS (SELECT pos, truth, k - 1 AS idx, 15.0::DOUBLE * embedding[k]::DOUBLE AS z FROM e),
 m AS (SELECT pos, max(z) AS m FROM z GROUP BY pos),
 w AS (SELECT z.pos, truth, idx, exp(z - m) AS w FROM z JOIN m ON z.pos = m.pos),
 q AS (SELECT pos, truth, idx, w / sum(w) OVER (PARTITION BY pos) AS conf FROM w),
 pr AS (SELECT pos, truth, idx AS pred, conf FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY conf DESC, idx) AS rn FROM q) WHERE rn = 1)"""
NAMES_SQL = "nm AS (SELECT DISTINCT nome FROM (SELECT unnest([" + ", ".join(map(quoted, LABEL_NAMES)) + "]) AS nome UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type FROM part)), nn AS (SELECT nome, regexp_replace(lower(nome), '[^\\p{L}\\p{N}]', '', 'g') AS normal FROM nm)"
HITS_SQL = f"{NAMES_SQL}, {PATTERNS_SQL}, hits AS (SELECT nome, idx FROM nn, pat GROUP BY nome, idx HAVING bool_and(contains(normal, pattern)))"
PATHS_SQL = "pa AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS caminho FROM pages UNION ALL SELECT unnest([" + ", ".join(map(quoted, PATHS)) + "]))"
ANSWERS_SQL = """an AS (SELECT doc_id AS pos, 'a' || doc_id AS arquivo, doc_id % 5 <> 0 AS e_planta, CASE WHEN quality = 1 THEN 'saudável' ELSE 'doente' END AS condicao, toxic,
  CASE WHEN doc_id % 3 = 0 THEN 'alta' ELSE 'média' END AS confianca, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'obs' END AS observacoes,
  NOT (doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0) AS valido FROM labels)"""
