"""Score vectors and remote answers to diagnostic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio import domain as D
from folio.functions import ranking, text


# How conditions are shown.
DISPLAY = {D.HEALTHY: "selo-saudavel", D.DISEASED: "selo-doente", D.UNDETERMINED: "selo-indeterminado"}


def display_class(condition: Column) -> Column:
    """The display class of a condition; of an unknown or null one, that of undetermined."""
    known = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    return F.coalesce(F.element_at(known, condition), F.lit(DISPLAY[D.UNDETERMINED]))


def class_map() -> Column:
    """idx to the catalogue's row, as a literal map: no join, no shuffle."""
    names = ["id", "cultura", "diagnostico", "condicao", "agente", "sintomas", "manejo"]
    entries = []
    for i, (id_, _, *rest) in enumerate(D.CATALOGUE):
        entries += [F.lit(i), F.struct(*[F.lit(v).alias(n) for n, v in zip(names, [id_, *rest], strict=True)])]
    return F.create_map(*entries)


def label_of(info: Column) -> Column:
    return F.concat_ws(" — ", info["cultura"], info["diagnostico"])


def of_catalogue(p: Column) -> Column:
    """The vector; one that is null or doesn't have a value for each class is an error, since its
    classes can't be those of the catalogue."""
    return F.when(F.size(p) == len(D.CATALOGUE), p).otherwise(F.raise_error(F.lit(f"a score vector must have {len(D.CATALOGUE)} values, one for each class of the catalogue")))


def with_class(predictions: DataFrame, column: str = "id_classe") -> DataFrame:
    """predictions with info, the catalogue's row of a class id; an unknown id is an error."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(["cultura", "diagnostico", "condicao", "agente", "sintomas", "manejo"], c[2:], strict=True)]) for c in D.CATALOGUE]
    of_id = F.create_map(*[x for c, row in zip(D.CATALOGUE, rows, strict=True) for x in (F.lit(c[0]), row)])
    found = F.element_at(of_id, F.col(column))
    return predictions.withColumn("info", F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(column), F.lit("null"))))))


def classify(scores: DataFrame, threshold: float = D.THRESHOLD, as_of: str | None = None, version: str = "stub v1.0.0") -> DataFrame:
    """(pos, record columns) from (arquivo, pos, p): the best class, unless it is under the
    threshold (strictly). as_of is the time of analysis, once for the batch; now, if None. Vectors
    that are null or not of the catalogue's classes are an error."""
    info = class_map()
    as_of = as_of or text.now_iso()
    d = scores.withColumn("_top", ranking.top_k(of_catalogue(F.col("p"))))
    best = d.withColumn("_best", F.element_at("_top", 1)).withColumn("_info", F.element_at(info, F.col("_best.idx")))
    under = F.col("_best.confianca") < threshold
    pick = lambda c, literal: F.when(under, F.lit(literal)).otherwise(F.col(f"_info.{c}"))
    return best.select(
        "pos",
        "arquivo",
        F.lit(as_of).alias("data_hora"),
        F.lit(D.CNN).alias("motor"),
        pick("cultura", D.UNDETERMINED_RECORD["especie"]).alias("especie"),
        pick("diagnostico", D.UNDETERMINED_RECORD["diagnostico"]).alias("diagnostico"),
        pick("condicao", D.UNDETERMINED_RECORD["condicao"]).alias("condicao"),
        F.col("_best.confianca").alias("confianca"),
        text.percent(F.col("_best.confianca")).alias("confianca_texto"),
        pick("agente", D.UNDETERMINED_RECORD["agente"]).alias("agente"),
        pick("sintomas", D.OUT_OF_DOMAIN % f"{threshold:.0%}").alias("sintomas"),
        pick("manejo", D.OUT_OF_DOMAIN_ADVICE).alias("manejo"),
        F.lit(version).alias("modelo_versao"),
        F.lit("").alias("observacoes"),
        F.transform("_top", lambda t: F.struct(F.element_at(info, t["idx"])["id"].alias("id_classe"), t["confianca"].alias("confianca"))).alias("ranking"),
    )


def parse_answers(answers: DataFrame, json_col: str = "resposta") -> DataFrame:
    """The table with the column laudo (the parsed answer) and valido: whether all fields are there
    and in their domains. Rows that aren't valid are for the caller to set aside."""
    d = answers.withColumn("laudo", F.from_json(json_col, D.VLM_ANSWER))
    there = F.lit(True)
    for f in D.VLM_ANSWER.names:
        there &= F.col(f"laudo.{f}").isNotNull()
    ok = there & F.col("laudo.condicao").isin(D.CONDITIONS) & F.col("laudo.confianca").isin(D.VLM_CONFIDENCE)
    return d.withColumn("valido", F.coalesce(ok, F.lit(False)))


def answers_to_records(parsed: DataFrame, as_of: str | None = None, version: str = "remote") -> DataFrame:
    """(pos, record columns) from valid answers (pos, arquivo, laudo); as_of as for classify()."""
    as_of = as_of or text.now_iso()
    a, no_plant = F.col("laudo"), ~F.col("laudo.e_planta")
    pick = lambda literal, c: F.when(no_plant, literal if isinstance(literal, Column) else F.lit(literal)).otherwise(c)
    return parsed.select(
        "pos",
        "arquivo",
        F.lit(as_of).alias("data_hora"),
        F.lit(D.VLM).alias("motor"),
        pick(D.NO_PLANT["especie"], a["especie"]).alias("especie"),
        pick(D.NO_PLANT["diagnostico"], a["diagnostico"]).alias("diagnostico"),
        pick(D.NO_PLANT["condicao"], a["condicao"]).alias("condicao"),
        F.lit(None).cast("double").alias("confianca"),
        pick(D.MISSING, F.concat(a["confianca"], F.lit(" (autoavaliada)"))).alias("confianca_texto"),
        pick(D.NO_PLANT["agente"], a["agente_causal"]).alias("agente"),
        pick(text.missing_to(a["sintomas_observados"], D.NO_PLANT_SYMPTOMS), a["sintomas_observados"]).alias("sintomas"),
        pick(D.NO_PLANT["manejo"], a["manejo_recomendado"]).alias("manejo"),
        F.lit(version).alias("modelo_versao"),
        pick(a["observacoes"], F.array_join(F.filter(F.array(F.concat(F.lit("Parte analisada: "), a["parte_analisada"]), a["observacoes"]), lambda x: x.isNotNull() & (x != "")), " · ")).alias("observacoes"),
        F.array().cast(D.RANKING).alias("ranking"),
    )
